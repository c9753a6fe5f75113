"""Future dates, gaps in date columns, and date pairs in the wrong order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordered import OrderedRows
from ..operators.quantiles import weighted_quantiles
from .findings import RowRule, empty_findings, table_finding

# Name parts of date pairs that have an order (earlier, later), the fewest dates a gap
# check needs, how many times the median a gap must be, and how many gap rows are listed.
ORDERED_PARTS = (
    ("start", "end"), ("begin", "end"), ("create", "update"), ("create", "close"), ("order", "ship"),
    ("order", "deliver"), ("open", "close"), ("birth", "death"), ("hire", "termin"),
)
GAP_MIN_DATES = 10
GAP_FACTOR = 5
GAP_ROWS = 10


def date_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """(earlier, later) date columns. Each column first gets the roles that its name tells: the hints in which it can be
    earlier or later. Two columns that fill both roles of a hint are a pair, in the order of their first such hint."""
    def roles(side: int) -> dict[str, set[int]]:
        return {c: {i for i, parts in enumerate(ORDERED_PARTS) if parts[side] in c.lower()} for c in columns}

    earlier, later = roles(0), roles(1)
    place = {c: i for i, c in enumerate(columns)}
    hints: dict[tuple[str, str], tuple[int, bool]] = {}
    for first in columns:
        for second in columns:
            shared = earlier[first] & later[second]
            if first != second and shared:
                # Of both directions the lower hint wins, at equal hints the order of the columns.
                hints[first, second] = min(shared), place[first] > place[second]
    chosen = [pair for pair, hint in hints.items() if hint < hints.get(pair[::-1], (len(ORDERED_PARTS), True))]
    return sorted(chosen, key=lambda pair: sorted((place[pair[0]], place[pair[1]])))


def future_rules(columns: Sequence[str], as_of: str | None = None) -> list[RowRule]:
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    return [
        RowRule(
            "future_date", "warning", "temporal", c,
            F.col(f"`{c}`").cast("timestamp_ntz") > now, F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd"),
            f"Found {{n}} future dates in '{c}'",
            "Scheduled dates may be fine; otherwise correct them.",
        )
        for c in columns
    ]


def ordering_rules(columns: Sequence[str]) -> list[RowRule]:
    rules = []
    for first, second in date_pairs(columns):
        a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
        shown = F.to_json(F.struct(a.cast("string").alias(first), b.cast("string").alias(second)))
        rules.append(RowRule(
            "date_order", "error", "temporal", f"{first}, {second}", a > b, shown,
            f"Found {{n}} rows where '{first}' is after '{second}'",
            "One of the two dates was probably entered wrongly.",
        ))
    return rules


def _micros(later: str, earlier: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, `{earlier}`, `{later}`)")


def date_steps(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Steps between neighbouring distinct moments: (column, moment, previous, rows_at, gap_us, first_key).

    Equal moments are counted before anything is sorted, so ties never travel as rows.
    """
    first_key = F.min(F.struct(*[F.col(k) for k in key])) if key else F.lit(None).cast("string")
    long = df.select(*key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("timestamp_ntz").alias("moment")) for c in columns
    ]))).where("moment is not null")
    counts = long.groupBy("column", "moment").agg(F.count("*").alias("rows_at"), first_key.alias("first_key"))
    stepped = OrderedRows(counts, ["moment"], ["column"]).with_previous(previous="moment").rows()
    return stepped.withColumn("gap_us", _micros("moment", "previous"))


def gap_summary(steps: DataFrame) -> DataFrame:
    """(column, n_dates, median_gap_us, n_gaps, largest_gap_us) of columns with at least ten dates.

    The median runs over row-to-row steps: repeated moments count as steps of zero length.
    """
    by_gap = steps.groupBy("column", "gap_us").agg(F.count("*").alias("cnt"), F.sum("rows_at").alias("rows_at"))
    sizes = by_gap.groupBy("column").agg(F.sum("rows_at").alias("n_dates"), F.sum("cnt").alias("n_moments"))
    lengths = by_gap.where("gap_us is not null").select("column", F.col("gap_us").cast("double").alias("value"), "cnt")
    zeros = sizes.select("column", F.lit(0.0).alias("value"), (F.col("n_dates") - F.col("n_moments")).alias("cnt"))
    median = weighted_quantiles(
        lengths.unionByName(zeros.where("cnt > 0")), [0.5], ["column"], few_groups=True
    ).select("column", F.col("quantile").alias("median_gap_us"))
    # One median per date column.
    joined = by_gap.join(F.broadcast(median), "column").where("median_gap_us > 0")
    wide = F.col("gap_us") > GAP_FACTOR * F.col("median_gap_us")
    gaps = joined.groupBy("column", "median_gap_us").agg(
        F.coalesce(F.sum(F.when(wide, F.col("cnt"))), F.lit(0)).alias("n_gaps"),
        F.max(F.when(wide, F.col("gap_us"))).alias("largest_gap_us"),
    )
    return gaps.join(F.broadcast(sizes), "column").where(F.col("n_dates") >= GAP_MIN_DATES).select(
        "column", "n_dates", "median_gap_us", "n_gaps", "largest_gap_us"
    )


def _duration(us: Column) -> Column:
    """``d days hh:mm:ss`` text of a length in microseconds."""
    seconds = F.floor(us / 1_000_000)
    return F.format_string(
        "%d days %02d:%02d:%02d", F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600),
        F.floor(seconds % 3600 / 60), seconds % 60,
    )


def gap_findings(df: DataFrame, columns: Sequence[str], key: Sequence[str], start: int = 0) -> DataFrame:
    """One finding per date column with large gaps, listing the rows that end the first ten of them."""
    spark = df.sparkSession
    if not columns:
        return empty_findings(spark)
    steps = date_steps(df, columns, key)
    # One row per date column, read once: the gap length becomes a literal of the row filter below.
    summary = gap_summary(steps).where("n_gaps > 0")
    rows = [tuple(r) for r in summary.collect()]
    if not rows:
        return empty_findings(spark)
    gaps = spark.createDataFrame(rows, summary.schema)
    limit = None
    for column, _, median, _, _ in rows:
        here = F.col("column") == column
        value = F.lit(GAP_FACTOR * median)
        limit = F.when(here, value) if limit is None else limit.when(here, value)
    listed = (
        steps.where(F.col("gap_us") > limit)
        .withColumn("rn", F.row_number().over(W.partitionBy("column").orderBy("moment")))
        .where(F.col("rn") <= GAP_ROWS)
        .groupBy("column").agg(F.transform(
            F.array_sort(F.collect_list(F.struct(
                "rn", F.concat_ws("|", *[F.col(f"first_key.{k}").cast("string") for k in key]).alias("k")
            ))), lambda s: s["k"],
        ).alias("keys"))
    )
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1
    position = F.lit(start) + place * 2 + 1  # each date column reports future dates, then gaps
    return gaps.join(F.broadcast(listed), "column").select(*table_finding(
        "date_gap", "info", "temporal", F.col("column"), F.col("n_gaps"),
        F.format_string(f"Found %d large gaps in '%s' (>{GAP_FACTOR}x median interval)", "n_gaps", "column"),
        "Find out whether data for these stretches was lost.",
        F.create_map(
            F.lit("count"), F.col("n_gaps").cast("string"),
            F.lit("median_gap"), _duration(F.col("median_gap_us")),
            F.lit("largest_gap"), _duration(F.col("largest_gap_us")),
        ),
        position, F.col("keys"),
    ))
