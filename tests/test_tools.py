"""Samples, charts, custom analyses, importance, conversations, sources, streams."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import charts, conversation, custom, describe, importance, profile, sample
from lumenframe.plans import eda, temporal
from lumenframe.plans.statistical import impossible_value_rules
from lumenframe.plans.validate import row_violations
from lumenframe.sources import (
    markdown_preview, read_column_json, read_csv, read_excel, read_json, read_table, with_row_id, write_csv, write_json,
)
from lumenframe.streaming import file_stream, rule_counts, stream_violations


def _strata(spark, parts):
    return spark.range(100).select("id", F.when(F.col("id") < 90, "A").when(F.col("id") < 99, "B").otherwise("C").alias("k")
                                   ).repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_stratified(spark, parts):
    drawn = sample.stratified_sample(_strata(spark, parts), "k", 50, ["id"])
    assert {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()} == {"A": 45, "B": 4, "C": 1}
    assert sorted(r["id"] for r in drawn.collect()) == sorted(
        r["id"] for r in sample.stratified_sample(_strata(spark, 2), "k", 50, ["id"]).collect())


def test_sample_strategies(spark):
    df = _strata(spark, 3)
    assert sample.sample_table(df, ["id"], 200, n_rows=100).count() == 100
    ends = sorted(r["id"] for r in sample.sample_table(df, ["id"], 5, "head_tail").collect())
    assert ends == [0, 1, 97, 98, 99]
    assert sample.sample_table(df, ["id"], 7, "random").count() == 7
    assert sample.data_sample(df, ["id"], 80).count() == 50
    with pytest.raises(ValueError, match="nope"):
        sample.select_columns(df, ["nope"])


def test_histogram_edges(spark):
    df = spark.range(31).select(F.col("id").cast("double").alias("x"))
    rows = {r["bucket"]: r["count"] for r in charts.histogram(df, "x").collect()}
    assert sum(rows.values()) == 31 and rows[30] == 2 and max(rows) == 30
    flat = charts.histogram(df.withColumn("x", F.lit(2.0)), "x").collect()
    assert [(r["bucket"], r["count"]) for r in flat] == [(1, 31)]


def test_histogram_counts_a_value_in_the_bin_that_begins_with_it(spark):
    # Prices whose span divides evenly; the last one of each row is the exact lower end of a bin.
    for low, high, border in ((900.0, 104999.88, 18249.98), (900.0, 104999.86, 52949.93)):
        df = spark.createDataFrame([(low,), (high,), (border,)], "x double")
        held = [r for r in charts.histogram(df, "x").collect() if r["bucket"] not in (1, 30)]
        assert [(r["lower"], r["count"]) for r in held] == [(border, 1)]


def test_histogram_counts_an_infinite_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (31.0,)], "x double")
    assert {r["bucket"]: r["count"] for r in charts.histogram(df, "x").collect()} == {1: 2, 30: 1}


def test_colored_histogram_counts_a_value_in_the_bin_that_begins_with_it(spark):
    rows = [(900.0, "A"), (104999.88, "A"), (18249.98, "A"), (18249.98, "R"), (18249.98, None)]
    found = charts.histogram(spark.createDataFrame(rows, "x double, flag string"), "x", "flag").collect()
    assert {(r["flag"], r["lower"], r["count"]) for r in found if r["bucket"] not in (1, 30)} == {
        (flag, 18249.98, 1) for flag in ("A", "R", None)}


def test_chart_dispatch(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"))
    assert charts.chart_data(df, "nonsense", "id") is None and charts.chart_data(df, "bar", "nope") is None
    assert charts.chart_data(df, "scatter", "id") is None
    assert charts.chart_data(df, "bar", "g", "id", aggregation="count").count() == 2
    for kind in charts.KINDS:
        assert charts.chart_data(df, kind, "g", "id").count() > 0


def test_box(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]], "v double")
    row = charts.box(df, "v").head()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 5.0, 1)


def test_custom_results(spark):
    df = spark.range(40).select("id", (F.col("id") % 3).alias("g"))
    kept = sorted(r["id"] for r in custom.as_table(df, ["id"]).collect())
    assert kept == list(range(15)) + list(range(25, 40))
    assert custom.as_table(df.where("id < 30"), ["id"]).count() == 30
    assert custom.as_scalar(df.agg(F.max("id"))).head()["value"] == 39
    with pytest.raises(Exception):
        custom.as_scalar(df).collect()
    assert custom.sql(df, "SELECT count(*) AS n FROM {data} WHERE g = :g", g=1).head()["n"] == 13
    pivot = custom.analyze(df, custom.Analysis(group_by=["g"], aggregates={"n": "count(*)"}, pivot="g"))
    assert pivot.columns == ["g", "0", "1", "2"]


def test_combined_ranking(spark):
    rows = [("one", "f1", 0.9), ("one", "f2", 0.5), ("two", "f2", 0.9), ("two", "f1", 0.6), ("two", "f3", 0.1)]
    got = {r["feature"]: r["avg_score"] for r in importance.combine_rankings(
        spark.createDataFrame(rows, "method string, feature string, score double")).collect()}
    assert got == {"f1": 0.8333, "f2": 0.75, "f3": 0.3333}


def test_importance_finds_the_driver(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=400), rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "z": z, "c": np.where(x > 0, "hi", "lo"), "y": 3 * x + 0.1 * rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    known = profile.infer_profile(df, {"x": "numeric", "z": "numeric", "y": "numeric"})
    got = importance.feature_importance(df, known, "y")
    assert got["combined_ranking"].head()["feature"] == "x"
    assert got["random_forest"].head()["feature"] == "x"
    by_class = importance.feature_importance(df, known, "c")
    assert "correlation" not in by_class and by_class["combined_ranking"].count() == 3
    with pytest.raises(ValueError):
        importance.feature_importance(df.limit(5), known, "y")


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_messages_for_model(spark):
    messages = _messages(spark, [
        (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", None), (1, 4, "system", "s"),
        (2, 0, "assistant", "hello"), (3, 0, "user", "x"), (3, 1, "assistant", "y"), (3, 2, "user", "p"), (3, 3, "user", "d"),
        (4, 0, "user", "q"),
    ])
    asked = spark.createDataFrame([(i, "d") for i in range(1, 6)], "conv_id bigint, text string")
    got = {}
    for r in conversation.messages_for_model(messages, asked).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got[1] == [("user", "a\nb"), ("assistant", "c"), ("user", "d")]
    assert got[2] == [("user", "d")] and got[5] == [("user", "d")]
    assert got[3] == [("user", "x"), ("assistant", "y"), ("user", "p\nd")]
    assert got[4] == [("user", "q\nd")]


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_merge_of_a_hot_conversation(spark, parts):
    rows = [(i % 5 if i % 2 else 0, i, "user" if (i // 3) % 2 else "assistant", f"m{i}") for i in range(120)]
    df = _messages(spark, rows).repartition(parts)
    def run(bounded):
        return sorted(tuple(r) for r in conversation.merge_roles(df, bounded).collect())
    assert run(True) == run(False)


def test_last_turns(spark):
    df = _messages(spark, [(1, i, "user", str(i)) for i in range(50)])
    assert sorted(r["turn"] for r in conversation.last_turns(df, 3).collect()) == list(range(44, 50))


def test_csv_types_and_markers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,1.5,x,true,N/A\n2,NA,y,False,\n,3,1,,\n")
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string"}
    assert df.where("b is null").count() == 1 and df.where("e is not null").count() == 0
    assert dict(read_csv(spark, str(path), schema="a int, b double, c string, d string, e string").dtypes)["a"] == "int"


def test_json_layouts(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "array.json").write_text('[{"a":1},\n{"a":2},{"a":3}]')
    (tmp_path / "cols.json").write_text(json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}))
    assert read_json(spark, str(tmp_path / "lines.json")).count() == 2
    assert read_json(spark, str(tmp_path / "array.json"), lines=False).count() == 3
    table = read_column_json(spark, str(tmp_path / "cols.json"))
    assert sorted((r["a"], r["b"]) for r in table.collect())[0] == (1, "x") and table.count() == 2


def _workbook(rows):
    cells = "".join(
        "<row>" + "".join(
            f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in row
        ) + "</row>" for row in rows
    )
    sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             f"<sheetData>{cells}</sheetData></worksheet>")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", sheet)
    return buffer.getvalue()


def test_excel_folder(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.xlsx").write_bytes(_workbook([["id", "name"], [1, f"{name} a"], [2, "b"]]))
    df = read_excel(spark, str(tmp_path), "id bigint, name string")
    assert df.count() == 4 and sorted(r["id"] for r in df.collect()) == [1, 1, 2, 2]
    assert {r["row_no"] for r in df.collect()} == {0, 1}


def _full_workbook(sheets, since_1904=False):
    """A workbook whose first sheet is not the first part, with date and number styles."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        listed = links = ""
        for i, rows in enumerate(sheets):
            part = len(sheets) - i
            listed += f'<sheet name="s{i}" sheetId="{i + 1}" r:id="r{i}"/>'
            links += f'<Relationship Id="r{i}" Target="worksheets/sheet{part}.xml"/>'
            cells = "".join("<row>" + "".join(
                f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else
                f'<c s="{v[1]}"><v>{v[0]}</v></c>' if isinstance(v, tuple) else "<c/>" if v is None else f"<c><v>{v}</v></c>"
                for v in row) + "</row>" for row in rows)
            archive.writestr(f"xl/worksheets/sheet{part}.xml",
                             f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="'
                         f'{int(since_1904)}"/><sheets>{listed}</sheets></workbook>')
        archive.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        archive.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
                         '<numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
                         '<xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    return buffer.getvalue()


@pytest.mark.parametrize("since_1904", [False, True])
def test_excel_without_schema(spark, tmp_path, since_1904):
    days = 45292 - 1462 * since_1904
    rows = [["id", "day", "moment", "amount", "note"], [1, (days, 1), (days + 0.5, 2), (1.5, 3), "x"],
            [2, None, (days + 1, 2), (2, 3), None]]
    path = tmp_path / "book.xlsx"
    path.write_bytes(_full_workbook([rows, [["other"], [1]]], since_1904))
    df = read_table(spark, str(path))
    assert df.dtypes[2:] == [("id", "bigint"), ("day", "timestamp_ntz"), ("moment", "timestamp_ntz"),
                             ("amount", "double"), ("note", "string")]
    first, second = sorted(df.collect(), key=lambda r: r["row_no"])
    assert str(first["day"]) == "2024-01-01 00:00:00" and str(first["moment"]) == "2024-01-01 12:00:00"
    assert second["day"] is None and second["note"] is None and str(second["moment"]) == "2024-01-02 00:00:00"
    assert read_excel(spark, str(path), sheet=1).columns == ["file", "row_no", "other"]


@pytest.mark.parametrize(("text", "rows"), [
    ('{"a":1,"b":"x"}\n{"a":2,"b":"y"}\n', 2), ('[{"a":1,"b":"x"},\n{"a":2,"b":"y"}]', 2),
    ('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}', 2), ('{"a": {"0": 1,\n "1": 2},\n "b": {"0": "x", "1": "y"}}', 2),
    ('{\n "a": 1,\n "b": "x"\n}', 1), ('\n {"a":1,"b":"x"}', 1),
])
def test_json_layout_is_looked_up(spark, tmp_path, text, rows):
    path = tmp_path / "t.json"
    path.write_text(text)
    df = read_table(spark, str(path))
    assert df.count() == rows and (1, "x") in {(r["a"], r["b"]) for r in df.collect()}


def test_csv_markers_with_a_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,N/A,NULL\nNA, 2.5 ,x\n")
    rows = read_csv(spark, str(path), schema="p int, q double, r string").collect()
    assert [tuple(r) for r in rows] == [(1, None, None), (None, 2.5, "x")]


def test_unsupported_format(spark):
    with pytest.raises(ValueError, match="Unsupported format"):
        read_table(spark, "/tmp/data.txt")


def test_row_identity(spark, sf_dir):
    df = with_row_id(spark, f"{sf_dir}/orders.parquet")
    assert df.select("row_file", "row_no").distinct().count() == df.count()


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "id bigint, x double")
    write_json(df, str(tmp_path / "j"))
    write_csv(df.where("id = 2"), str(tmp_path / "c"))
    assert read_json(spark, str(tmp_path / "j")).where("x is null").count() == 1
    assert read_csv(spark, str(tmp_path / "c")).head()["x"] == 2.5


def test_markdown(spark):
    text = markdown_preview(spark.range(50).toDF("id"), ["id"]).head()["text"]
    assert text.startswith("| id |\n|---|\n| 0 |") and text.endswith("... (20 rows omitted) ...")
    short = markdown_preview(spark.range(2).toDF("id"), ["id"]).head()["text"]
    assert short == "| id |\n|---|\n| 0 |\n| 1 |"


def test_auto_eda_sections(spark):
    df = spark.range(60).select(
        "id", (F.col("id") * 2.0).alias("amount"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(int(id))").alias("at"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"),
    )
    got = eda.auto_eda(df, ["id"])
    assert {"statistics", "correlations", "heatmap", "histogram:amount", "trend:linear_trend", "line", "bar:kind", "summary"} <= set(got)
    assert "Strongest correlation: id ↔ amount (1.00, very strong)" in got["summary"].head()["summary"]
    assert "visualization" in eda.explain_eda(got).head()["narrative"]


def test_row_rules_on_a_stream(spark, tmp_path):
    rows = spark.range(100).select(
        "id", F.expr("timestamp'2024-01-01' + make_dt_interval(0, int(id))").alias("ts"), (F.col("id") - 90.0).alias("price")
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), rows.schema)
    counted = rule_counts(stream_violations(stream, impossible_value_rules(["price"]), ["id"], "ts"), "ts", "1 day")
    query = (counted.writeStream.outputMode("complete").format("memory").queryName("watched")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sum(r["n_rows"] for r in spark.table("watched").collect()) == 90
    known = profile.infer_profile(rows)
    streamed = row_violations(stream, ["id"], known, checks=["statistical", "temporal"], with_bounds=False)
    assert streamed.isStreaming
    assert temporal.future_rules(["ts"])[0].rule == "future_date"


def test_statistics_in_one_call(spark):
    df = spark.createDataFrame(
        [(g, float(i % 7), "even" if i % 2 == 0 else None, i % 3 == 0) for i, g in enumerate("ab" * 10 + "ccc")],
        "g string, v double, parity string, third boolean")
    found = {r.column: r for r in describe.compute_statistics(df, ["v", "parity", "third", "missing"]).collect()}
    assert set(found) == {"v", "parity", "third"}
    assert found["v"].kind == "numeric" and found["v"]["count"] == 23 and found["v"].is_normal is not None
    assert (found["parity"].unique_count, found["parity"].mode, found["parity"].missing_count) == (1, "even", 11)
    assert [tuple(x) for x in found["third"].top_values] == [("false", 15), ("true", 8)]
    groups = {r.group: r for r in describe.compute_statistics(df, ["v", "parity"], "g").collect()}
    assert {g: r["count"] for g, r in groups.items()} == {"a": 10, "b": 10, "c": 3}
    assert groups["c"].is_normal is None and groups["a"].is_normal is not None
    with pytest.raises(ValueError, match="Neither"):
        describe.compute_statistics(df, ["missing"]).collect()
