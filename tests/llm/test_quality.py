import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import quality, queries


def plain_margin(trees, row):
    total = trees.base
    for root in trees.roots:
        at = root
        for _ in range(trees.depth):
            at = trees.left[at] + (row[trees.feature[at]] > trees.cut[at])
        total += trees.value[at]
    return total


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(size=(600, 3)), rng.integers(0, 3, 600)]
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] == 1)).astype(float)
    trees = quality.fit(x[:400], y[:400])
    assert [plain_margin(trees, r) for r in x] == pytest.approx(trees.margins(x).tolist())
    assert ((trees.scores(x[400:]) >= 0.5) == y[400:]).mean() > 0.95


@pytest.mark.parametrize("y", [[], [1.0] * 50, [0.0, 1.0]])
def test_too_little_to_learn(y):
    x = np.zeros((len(y), 2))
    trees = quality.fit(x, np.array(y))
    want = (sum(y) + 1) / (len(y) + 2)
    assert trees.scores(np.ones((3, 2))) == pytest.approx([want] * 3)


@pytest.mark.parametrize("text", ["", " ", "one", "a\n" * 5, "é!! x|", "A" * 100_000, "w " * 50_000])
def test_statistics_are_finite(text):
    row = quality.statistics(text.encode())
    assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op7_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in judged) / len(judged) >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good text here", 5), (1, "good text here", 5), (2, None, 5), (None, "", 5), (3, "bad", 5)],
        "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    trees = quality.train(docs, labels, F.lit(True))
    scored = quality.score(docs, trees)
    assert scored.columns == ["doc_id", "text", "label", "quality_score"]
    assert {round(r.quality_score, 6) for r in scored.collect()} == {round(2 / 3, 6)}
    assert quality.score(docs.where("false"), trees).collect() == []
