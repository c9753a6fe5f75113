import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lumenframe.llm import packing
from lumenframe.llm.tokens import default_tokenizer, word_table

PATH = default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_table_encoder_equals_whole_texts(spark):
    rng = np.random.default_rng(6)
    alphabet = list("aB'sé \n\x0b\x1c\u0301\u00a0!<|>\t3日 ")
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 400)]
    texts += ["a <|endoftext|> b<|startoftext|>", "x" * 5000, "don't they'll 12 café cafe\u0301", ""]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect()]
    table = word_table(spark.createDataFrame([(t,) for t in texts], "text string"), PATH)
    coded = table.reader().encode([t.encode() for t in texts])
    for text, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_windows_hold_every_piece_within_capacity(lengths):
    lengths = np.array(lengths)
    window = packing.pack(lengths, 64)
    assert len(window) == len(lengths) and (window >= 0).all()
    assert np.bincount(window, lengths).max() <= 64


def test_differencing_is_near_equal():
    lengths = np.random.default_rng(1).integers(1, 300, 900)
    sums = np.bincount(packing.differencing(lengths, 40), lengths, 40)
    assert sums.max() - sums.min() <= 2
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_rebuild_every_document(spark, capacity):
    rng = np.random.default_rng(2)
    texts = [None, "", "short", "short"] + [" ".join(f"word{i}" for i in rng.integers(0, 50, n))
                                            for n in rng.integers(1, 900, 60)]
    texts.append("long text " * 9000)
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, offset int").repartition(3)
    got = packing.pack_documents(docs, PATH, capacity).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text, *_ in rows:
        ids, at = ids_of(text), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in got)
    if capacity == 2048:
        assert len(sequences) * capacity <= total + 8 * capacity


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH).collect() == []


def test_window_count_starts_at_the_tokens_over_the_capacity():
    assert packing.pack(np.array([1000, 1045]), 2048).tolist() == [0, 0]
    assert packing.pack(np.array([1024, 1024]), 2048).tolist() == [0, 0]
    assert sorted(packing.pack(np.array([1025, 1025, 1025]), 2048).tolist()) == [0, 1, 2]
    lengths = np.full(700, 1025)
    assert len(set(packing.pack(lengths, 2048).tolist())) == 700
