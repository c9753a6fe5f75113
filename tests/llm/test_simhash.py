import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from lumenframe.llm import simhash


def plain_fingerprint(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), 42)
              for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(ids, values, radius=2):
    label = dict(zip(ids, ids, strict=True))
    moved = True
    while moved:
        moved = False
        for i, a in zip(ids, values, strict=True):
            for j, b in zip(ids, values, strict=True):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


@given(st.text(alphabet="aB c\nä \x1c", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint_matches_definition(text):
    assert simhash.text_fingerprint(text.encode(), 3) == plain_fingerprint(text)


def test_long_text_counts_every_shingle():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.text_fingerprint(text.encode(), 3) == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [2, 2048])
def test_components_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    base = [f"alpha beta{i} gamma delta{i} epsilon" for i in range(15)]
    long = " ".join(f"word{i}" for i in range(400))
    texts = base + [None, "", " \n", "x", "x", base[0], base[0].upper(), long, long + " tail", long.replace("word7 ", "w ")]
    rows = [(i + 1, t, "clash", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    values = [plain_fingerprint(t) for t in texts]
    want = plain_components([r[0] for r in rows], values)
    assert len(got) == len(rows)
    for (i, *_), value in zip(rows, values, strict=True):
        assert got[i].fingerprint == f"{value:016x}"
        assert got[i].component_id == want[i]


def test_plan_of_the_buckets_stays_small_at_a_wide_radius(spark):
    wide = simhash.bucketed(spark.range(10).selectExpr("id node", "id fp"), 6)
    assert len(wide._jdf.queryExecution().optimizedPlan().toJSON()) < 200_000


@pytest.mark.parametrize("hot", [1, 2048])
def test_buckets_bring_all_within_the_radius_together(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    base = [0, -1, 0x0123456789ABCDEF, 1 << 62]
    rng = np.random.default_rng(3)
    values = [b ^ int(sum(1 << int(i) for i in rng.choice(62, k, replace=False))) for b in base for k in (0, 1, 3, 6)]
    rows = spark.createDataFrame(list(enumerate(values)), "node long, fp long")
    keys: dict[int, set] = {}
    for r in simhash.bucketed(rows, 6).collect():
        keys.setdefault(r.node, set()).add(r.key)
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            assert ((a ^ b) & (1 << 64) - 1).bit_count() > 6 or keys[i] & keys[j]


@given(st.lists(st.integers(0, 255), min_size=1, max_size=40, unique=True), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_tree_search_finds_every_pair(values, radius):
    values = np.array(values, np.uint64)
    tree = np.arange(len(values)) % 2
    tree = np.unique(tree, return_inverse=True)[1]
    got = {tuple(p) for pairs in simhash.search_forest(values, tree, radius) for p in pairs.T.tolist()}
    want = {(i, j) for i in range(len(values)) for j in range(len(values))
            if i != j and tree[i] == tree[j] and int(values[i] ^ values[j]).bit_count() <= radius}
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
