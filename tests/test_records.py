import csv
import io
import json

import numpy as np
import pytest

from lumenframe.sources import read_table
from lumenframe.sources.readers import read_csv, read_json
from lumenframe.sources.records import array_records, csv_records


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, so that records cross many borders."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def rows():
    rng = np.random.default_rng(1)
    odd = ['plain', 'two\nlines', 'quote " inside', '""', 'comma, and\n"both"\n', '{"a": [1, "}"]}', '\\', 'back\\"slash', 'é\r\nü', '}', '][']
    return [(i, odd[rng.integers(len(odd))] + odd[rng.integers(len(odd))] * int(rng.integers(1, 4)), float(i) / 4) for i in range(300)] + [
        (300, "long\n" * 500, 0.5), (301, "{" * 900, 1.5)]


def test_multiline_csv_in_many_tasks(spark, tmp_path, small_blocks):
    for part, some in enumerate((rows()[:200], rows()[200:])):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if part else "\n", quoting=csv.QUOTE_ALL)
        writer.writerow(["id", "text", "share"])
        writer.writerows(some)
        (tmp_path / f"{part}.csv").write_bytes(out.getvalue().encode())
    assert csv_records(spark, str(tmp_path)).select("file", "block").distinct().count() > 25
    got = read_csv(spark, str(tmp_path), schema="id bigint, text string, share double", multiline=True)
    assert sorted(map(tuple, got.collect())) == sorted(rows())
    inferred = read_csv(spark, str(tmp_path), multiline=True)
    assert dict(inferred.dtypes) == {"id": "bigint", "text": "string", "share": "double"}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_in_many_tasks(spark, tmp_path, small_blocks, indent):
    records = [{"id": i, "text": t, "deep": {"list": [x, {"k": "}"}]}} for i, t, x in rows()]
    path = tmp_path / "table.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=False) + "\n")
    assert array_records(spark, str(path)).select("block").distinct().count() > 25
    got = read_json(spark, str(path), lines=False).select("id", "text").collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for i, t, _ in rows())


def test_small_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\"a\nb\"")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), multiline=True).collect()] == [(1, "a\nb")]
    (tmp_path / "b.csv").write_text("x,y\n")
    assert read_csv(spark, str(tmp_path / "b.csv"), multiline=True).columns == ["x", "y"]
    (tmp_path / "c.json").write_text("[]")
    assert read_json(spark, str(tmp_path / "c.json"), lines=False).count() == 0
    (tmp_path / "d.json").write_text('[\n {"x": 1},\n {"x": 2}\n]')
    assert sorted(r.x for r in read_table(spark, str(tmp_path / "d.json")).collect()) == [1, 2]
