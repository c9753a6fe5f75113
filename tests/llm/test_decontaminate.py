import random

import pytest
from hypothesis import given, settings, strategies as st

from lumenframe.llm import decontaminate, queries


def plain_distance(pattern, text):
    """Edit distance of a pattern to the nearest part of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@given(st.text("ab c", min_size=1, max_size=12), st.text("ab c", min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    want = plain_distance(pattern, text)
    got, end = decontaminate.myers(pattern, text, len(pattern))
    assert got == want and end >= 0


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        chars[at:at + 1] = ["x"] if kind == 0 else [] if kind == 1 else [chars[at], "y"]
    return "".join(chars)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gam", "de", "epsilon", "zeta", "et"]) + str(rng.randrange(90))
                               for _ in range(n))
    items = [(i, words(8 + 4 * i)) for i in range(8)] + [(90, None), (91, ""), (92, "too short"), (93, words(9)), (94, "__ +-"), (96, "short!")]
    items.append((95, items[3][1]))
    docs = [(0, None), (1, ""), (2, " \n"), (None, f"x {items[2][1]}")]
    for i, (_, text) in enumerate(items[:8] + items[11:12]):
        for edits in (0, 1, 3, 6, 14, 40):
            docs.append((10_000 + 100 * i + edits, f"{words(30)} {edited(text, edits, rng).upper()}, {words(20)}"))
        docs.append((1000 + i, text[: len(text) // 2]))
    docs += [(6000, "This is Too-short, not tooshort."), (6001, "it is too shorter"), (6002, "ashort")]
    docs += [(5000, f"{items[0][1]}! {items[0][1]}"), (5001, words(40_000) + " " + items[5][1]), docs[5], docs[5]]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, distance int")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(frame, bench).collect()), key=str)
    want = []
    for doc, text in docs:
        if doc == 5001:
            want += [(5001, 5, 0)]
            continue
        for p in decontaminate.patterns(items):
            distance = plain_distance(p.text, decontaminate.normal(text))
            if distance <= p.budget:
                want.append((doc, p.item, distance))
    assert got == sorted(want, key=str)
    assert {(6000, 92, 0), (6000, 96, 0)} == {x for x in got if x[0] in (6000, 6001, 6002)}
    assert sorted(r.item_id for r in decontaminate.wordless(bench).collect()) == [90, 91, 94]
    left = decontaminate.clean(frame, bench)
    assert left.columns == frame.columns
    hit = {x[0] for x in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in hit)


@pytest.mark.parametrize("limit", [200, 10])
def test_blocks_together_are_the_benchmark(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", limit)
    bench = spark.createDataFrame([(i, f"item number {i} has text that is long enough") for i in range(20)],
                                  "item_id long, text string")
    blocks = list(decontaminate._blocks(bench))
    assert len(blocks) > 2 and sorted(p.item for b in blocks for p in b) == list(range(20))
    docs = spark.createDataFrame([(1, "Item number 7 has text that is long enough")], "doc_id long, text string")
    assert 7 in {r.item_id for r in decontaminate.matches(docs, bench).collect()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, bench).collect() == []
    assert decontaminate.clean(docs, bench).count() == 1
    assert decontaminate.matches(docs.where("false"), bench).collect() == []


def test_given_passages_are_found(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_pigeonhole"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for item, text in items:
            if text in r.text:
                assert (r.doc_id, item) in found
