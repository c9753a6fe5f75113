"""Scores, summaries and narratives of findings; every table of a many-table run gets its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Points each finding costs, most messages per severity, findings returned by the report.
PENALTIES = {"error": 10, "warning": 3, "info": 1}
SHOWN_MESSAGES = 5
SHOWN_FINDINGS = 20
# Fixed formats of the report texts.
SCORE_LINE = "Data Quality Score: %.0f/100"
COUNT_LINE = "Found %d issues: %d errors, %d warnings, %d informational."
CLEAN_LINE = "No data quality issues found. Your data looks clean!"
ERROR_HEAD = "\nCritical issues that need attention:"
WARNING_HEAD = "\nWarnings to review:"
CLEAN_STORY = (
    "Great news! Your data scored %.0f/100 on our quality assessment. No significant issues were found."
)
STORY_HEAD = "I analyzed your data quality and found **%d issues** (score: %.0f/100).\n"
STORY_ERRORS = "**%d critical issue(s) need attention:**\n"
STORY_WARNINGS = "\n**%d warning(s) to review:**\n"


def _counted() -> list[Column]:
    return [F.count("*").alias("finding_count"),
            *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in PENALTIES]]


def _with_score(counted: DataFrame) -> DataFrame:
    lost = sum((F.col(f"{s}_count") * p for s, p in PENALTIES.items()), F.lit(0))
    return counted.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost)))


def severity_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings.groupBy(*by).agg(*_counted())


def quality_score(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Severity counts and the 0-100 score: 100 minus 10, 3 or 1 points per finding."""
    return _with_score(severity_counts(findings, by))


def top_findings(findings: DataFrame, n: int = SHOWN_FINDINGS) -> DataFrame:
    """The first findings in report order, without row keys and evidence."""
    return findings.orderBy("position", "rule", "column").select(
        "severity", "category", "column", "message", "suggestion"
    ).limit(n)


def _block(flag: Column, head: Column | str, lines: Column) -> Column:
    top = head if isinstance(head, Column) else F.lit(head)
    return F.when(flag, F.concat_ws("\n", top, F.array_join(lines, "\n")))


def _scored(findings: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Counts, score and the first messages of each severity, from one pass over the findings.

    A table has one finding per rule and column at most, so the list gathered for it is schema-sized.
    """
    entry = F.struct("position", "rule", "column", "severity", "message", "suggestion")
    rows = findings.groupBy(*by).agg(*_counted(), F.array_sort(F.collect_list(entry)).alias("told"))

    def first(severity: str) -> Column:
        return F.slice(F.filter("told", lambda m: m["severity"] == severity), 1, SHOWN_MESSAGES)

    return _with_score(rows).withColumns({"errors": first("error"), "warnings": first("warning")}), list(by)


def summary_text(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., counts, score, summary)."""
    rows, keys = _scored(findings, by)
    n, e, w, i = (F.col(f"{c}_count") for c in ("finding", "error", "warning", "info"))
    text = F.concat_ws(
        "\n",
        F.format_string(SCORE_LINE, "score"),
        F.when(n == 0, F.lit(CLEAN_LINE)).otherwise(F.format_string(COUNT_LINE, n, e, w, i)),
        _block(e > 0, ERROR_HEAD, F.transform("errors", lambda m: F.concat(F.lit("  - "), m["message"]))),
        _block(w > 0, WARNING_HEAD, F.transform("warnings", lambda m: F.concat(F.lit("  - "), m["message"]))),
    )
    return rows.select(
        *keys, "finding_count", "error_count", "warning_count", "info_count", "score", text.alias("summary")
    )


def narrative(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., narrative): the same content told as numbered lists, errors with their suggestion."""
    rows, keys = _scored(findings, by)
    n, e, w = F.col("finding_count"), F.col("error_count"), F.col("warning_count")
    errors = F.transform("errors", lambda m, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), m["message"],
        F.when(m["suggestion"] != "", F.concat(F.lit("\n   *Suggestion:* "), m["suggestion"], F.lit("\n"))).otherwise(""),
    ))
    warnings = F.transform("warnings", lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m["message"]))
    text = F.concat_ws(
        "\n",
        F.format_string(STORY_HEAD, n, F.col("score")),
        _block(e > 0, F.format_string(STORY_ERRORS, e), errors),
        _block(w > 0, F.format_string(STORY_WARNINGS, w), warnings),
    )
    return rows.select(
        *keys, F.when(n == 0, F.format_string(CLEAN_STORY, "score")).otherwise(text).alias("narrative")
    )
