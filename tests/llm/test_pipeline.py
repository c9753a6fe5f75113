import re
from collections import Counter

import corpus_pipeline
from lumenframe.llm import decontaminate, quality, secret_scan
from lumenframe.llm.packing import CAPACITY

FOLDER = "/root/testdata/sf0.01"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, FOLDER)
    assert good.columns == columns
    kept = {r.doc_id: r for r in good.collect()}
    assert all(rows[d] == r for d, r in kept.items())
    judged = [(d in kept) == (labels[d] == 1) for d in rows if d in labels]
    assert sum(judged) / len(judged) > 0.97

    groups: dict[int, int] = {d: d for d in kept}
    sets, holders = {}, {}
    for d, r in kept.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in r.text or ""))
        n = corpus_pipeline.SHINGLE
        sets[d] = {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
        for x in sets[d]:
            holders.setdefault(x, []).append(d)

    def find(d):
        while groups[d] != d:
            d = groups[d]
        return d
    ids = sorted(kept)
    for a in ids:
        shared = Counter(b for x in sets[a] for b in holders[x] if b > a)
        for b, both in shared.items():
            if both >= corpus_pipeline.SIMILARITY * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                groups[max(x, y)] = min(x, y)
    single = stages["near_duplicates"](spark, good, FOLDER)
    assert single.columns == columns
    left = {r.doc_id: r for r in single.collect()}
    assert len(left) == len({find(d) for d in ids}) == len({find(d) for d in left})
    assert all(rows[d] == r for d, r in left.items())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    free = stages["benchmarks"](spark, single, FOLDER)
    freed = {r.doc_id for r in free.collect()}
    found = decontaminate.Matcher(decontaminate.patterns(items))
    assert freed == {d for d, r in left.items() if not found.find(r.text)}
    assert not any(text in left[d].text for d in freed for _, text in items)

    owners: dict[str, set] = {}
    for d in freed:
        for _, s, e in secret_scan._found(left[d].text or ""):
            owners.setdefault(secret_scan._digest(left[d].text[s:e]), set()).add(left[d].source)
    safe = {r.doc_id: r for r in stages["secrets"](spark, free, FOLDER).collect()}
    assert set(safe) == freed
    for d, r in safe.items():
        text = left[d].text
        live = [(s, e) for _, s, e in secret_scan._found(text) if len(owners[secret_scan._digest(text[s:e])]) <= 2]
        assert r.text == secret_scan._masked(text, live, "[secret]") and r.n_chars == len(r.text)

    frame = spark.createDataFrame(list(safe.values()), docs.schema)
    pieces = stages["packing"](spark, frame, FOLDER).collect()
    assert {p.doc_id for p in pieces} == freed
    sums: dict[int, int] = {}
    for p in pieces:
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
    assert max(sums.values()) <= CAPACITY


ODD = [(1, None, "en", "s", None, 7, 0.5, "k"), (1, None, "en", "s", None, 7, 0.5, "k"), (None, "", None, None, 0, 7, 0.5, "k"),
       (2, "plain words of a text", "en", None, 21, 7, 0.5, "k"), (2, "another text under this id", "en", None, 26, 7, 0.5, "k"),
       (3, "long text " * 50_000 + "end", "en", "s", 500_003, 7, 0.5, "k")]
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp int, quality_score double, __key string")


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(docs, allowMissingColumns=True)
    good = corpus_pipeline.good_quality(spark, whole, FOLDER)
    assert good.columns == whole.columns and good.where("quality_score = 0.5").count() <= len(ODD)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
    single = corpus_pipeline.one_of_each_group(spark, docs, FOLDER).collect()
    assert sorted(str(r.text)[:10] for r in single if r.text) == ["another te", "long text ", "plain word"]
    assert len(single) == 4
    pieces = corpus_pipeline.packed(spark, docs, FOLDER).collect()
    assert sum(p.length for p in pieces if p.doc_id is None) == 1 and {p.doc_id for p in pieces} == {1, 2, 3, None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], ODD_SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, FOLDER).collect() == []


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert quality.THRESHOLD == 0.3
