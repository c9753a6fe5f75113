import numpy as np
import pytest
from lumenframe.llm import token_scan
from lumenframe.llm.shared import mounted, shared_path
from lumenframe.llm.tokens import default_byte_encoder, default_tokenizer, word_table

END = 9


def flat(spark, files):
    folder = shared_path(spark, "flat")
    import os
    os.makedirs(mounted(folder))
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(f"{mounted(folder)}/{name}")
    return folder, spark.createDataFrame([(n,) for n in files], "file string")


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_matches_brute_force(spark, block):
    rng = np.random.default_rng(block)
    files = {f"f{i}": rng.choice([1, 2, 3, END], n, p=[.3, .3, .3, .1]).tolist() for i, n in enumerate([0, 1, 40, 97])}
    files |= {"none": [1] * 23, "ends": [END] * 11, "long": [1] * 50 + [END] + [2] * 30 + [END]}
    want = []
    for name, ids in files.items():
        length = ordinal = 0
        for x in ids:
            length += 1
            if x == END:
                want.append((name, ordinal, length))
                ordinal, length = ordinal + 1, 0
        if length:
            want.append((name, ordinal, length))
    got = token_scan.scan_flat(spark, *flat(spark, files), END, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_of_documents(spark):
    plain = default_byte_encoder()().encoding
    texts = [None, "", "a b c", "a b c", "word " * 40_000, "ünï 'd", "<|endoftext|>", "x" * 30_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y", 1), (2, "a b c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ordinal int").repartition(3)
    got = token_scan.token_counts(docs, default_byte_encoder(), 50_256).collect()
    want = [(i, len(plain.encode_ordinary(t or "")) + 1) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_with_a_word_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    table = word_table(docs, default_tokenizer())
    got = dict(map(tuple, token_scan.token_counts(docs, table.reader, 65_535).collect()))
    assert got == {1: 3, 2: 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_scan.token_counts(docs, default_byte_encoder(), 50_256).collect() == []
