import random

import corpus_pipeline
from lumenframe.llm.components import components
from lumenframe.llm.simhash import text_fingerprint
from lumenframe.llm.similar_texts import similar_texts


def shingles(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(a, b):
    both = len(a & b)
    return 10 * both >= 8 * (len(a) + len(b) - both)


def plain_groups(texts):
    """Smallest key of each text's group, by comparing every pair."""
    sets = {d: shingles(t) for d, t in texts.items()}
    label = {d: d for d in texts}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = find(a), find(b)
            if x != y and alike(sets[a], sets[b]):
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(words, changes, seed):
    out = list(words)
    for at in random.Random(seed).sample(range(len(out)), changes):
        out[at] = f"edit{seed}x{at}"
    return " ".join(out)


def test_groups_match_brute_force_around_the_limit(spark):
    rows = {}
    for base in range(30):
        words = [f"b{base}w{i}" for i in range(120)]
        for copy in range(8):  # one to five scattered changes: similarities from about 0.65 to 0.92
            rows[len(rows)] = edited(words, copy % 5 + 1, base * 10 + copy) if copy else " ".join(words)
    shared = [f"common{i}" for i in range(90)]
    for i in range(60):  # a long common passage alone does not join texts
        rows[len(rows)] = " ".join(shared + [f"own{i}w{j}" for j in range(45)])
    chain = [f"c{i}" for i in range(400)]
    for i in range(40):  # neighbours are alike, ends are not
        rows[len(rows)] = " ".join(chain[5 * i:5 * i + 120])
    for text in (None, "", " \n", "x", "X", "x y", "one two three four", "one two three four five six"):
        rows[len(rows)] = text
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows.items()], "doc_id long, text string, component_id string")
    got = {r.doc_id: r.component_id for r in similar_texts(docs).collect()}
    want = plain_groups(rows)
    assert got == want
    assert len(set(want.values())) < len(rows) - 100


def test_large_groups_without_a_middle_and_mixed_edits(spark):
    rng = random.Random(4)
    words = [f"m{i}" for i in range(300)]
    edits = [(rng.randrange(300), f"swap{j}") for j in range(12)]
    rows = {}
    for _ in range(250):  # edits drawn from a common stock, so that their shingles are shared too
        out = list(words)
        for at, new in rng.sample(edits, rng.randint(2, 9)):
            out[at] = new
        rows[len(rows)] = " ".join(out)
    for i in range(80):  # halves of one text: every shingle is shared, sizes allow, few are alike
        out = [w for at, w in enumerate(words) if (at // 30) in rng.sample(range(10), 7)]
        rows[len(rows)] = " ".join(out)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_texts(docs).collect()} == plain_groups(rows)


def test_rare_shingles_alone_find_all_groups(spark, monkeypatch):
    monkeypatch.setattr("lumenframe.llm.similar_texts.LEADER_ROUNDS", 1)
    monkeypatch.setattr("lumenframe.llm.similar_texts._with_leaders",
                        lambda named, seed, similarity: named.selectExpr("node a", "node b").where("false"))
    rows = {}
    for base in range(12):
        words = [f"r{base}w{i}" for i in range(100)]
        for copy in range(12):
            rows[len(rows)] = edited(words, copy % 4 + 1, base * 20 + copy)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_texts(docs).collect()} == plain_groups(rows)


def test_the_stage_links_what_the_trees_propose(spark, monkeypatch):
    none = lambda named, *_: named.selectExpr("node a", "node b").where("false")
    monkeypatch.setattr("lumenframe.llm.similar_texts._with_leaders", none)
    monkeypatch.setattr("lumenframe.llm.similar_texts._across", none)
    rows = {}
    for base in range(40):
        words = [f"s{base}w{i}" for i in range(200)]
        rows[2 * base], rows[2 * base + 1] = " ".join(words), edited(words, base % 4 + 1, base)
    marks = {d: text_fingerprint(t.encode(), 5) for d, t in rows.items()}
    linked = [d for d in range(0, 80, 2) if (marks[d] ^ marks[d + 1]).bit_count() <= corpus_pipeline.NEAR_BITS
              and alike(shingles(rows[d]), shingles(rows[d + 1]))]
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert len(linked) > 15 and left == set(rows) - {d + 1 for d in linked}


def test_equal_fingerprints_are_no_link_without_similarity(spark, monkeypatch):
    monkeypatch.setattr("lumenframe.llm.simhash.fingerprints", lambda docs, shingle: docs.selectExpr("doc_id", "0L fp"))
    rows = {d: " ".join(f"e{d // 2}w{i}" for i in range(60)) + f" end{d}" for d in range(30)}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_texts(docs).collect()} == plain_groups(rows)


def test_the_stage_keeps_one_of_each_group_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = plain_groups({r.doc_id: r.text for r in docs.collect()})
    left = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert len(left) == len(set(groups.values()))
    assert {groups[d] for d in left} == set(groups.values())


def test_links_are_gone_through_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("lumenframe.llm.similar_texts.components", lambda edges: seen.append(edges.count()) or components(edges))
    rows = {}
    for base in range(20):
        words = [f"o{base}w{i}" for i in range(200)]
        for copy in range(3):
            rows[len(rows)] = edited(words, copy, base * 10 + copy) if copy else " ".join(words)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_texts(docs).collect()} == plain_groups(rows)
    assert 40 <= sum(seen) <= 3 * 20  # a group of three has three pairs at most


def test_empty_table(spark):
    assert similar_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
