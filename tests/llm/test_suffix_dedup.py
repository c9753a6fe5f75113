import hashlib
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import induced_sort, suffix_dedup


def plain(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), text in zip(rows, texts, strict=True):
        gone = np.zeros(len(text) + 2, bool)
        for i in range(len(text) - window + 1):
            if seen[text[i:i + window]] > 1:
                gone[i + 1:i + window + 1] = True
        kept = bytes(b for b, g in zip(text, gone[1:], strict=False) if not g)
        out.append((doc, len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(window):
    rng = np.random.default_rng(5)
    letters = lambda n, v: "".join(chr(97 + c) for c in rng.integers(0, v, n))
    passage, line = letters(window + 30, 26), letters(window, 26)
    texts = [None, "", "short", "x" * (3 * window), "x" * window + "y", "ab" * window, letters(4 * window, 2)]
    for i in range(12):
        texts.append(letters(40, 26) + passage[i % 5:window + 20 + i] + letters(3 * i, 26))
        texts.append(letters(7, 26) + "\n" + line + ("é" * i) + (line if i == 3 else ""))
    base = letters(3 * window, 26) + "ünïcode" * 9
    texts += [base, base, base[:window] + "!" + base[window + 1:], base[25:], base.upper(), "ä" * window]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9], (5, "clash of ids")]


@pytest.mark.parametrize(("window", "k", "hot"), [(200, 32, 100_000), (40, 8, 2), (12, 12, 100_000)])
def test_matches_brute_force(spark, monkeypatch, window, k, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_WAYS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_K", 30 if window == 40 else 160)
    rows = fixture(window)
    docs = spark.createDataFrame([(*r, 1, b"2") for r in rows], "doc_id long, text string, anchor int, key binary")
    got = suffix_dedup.remove_repeats(docs, window, k)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, window)


def test_very_long_text(spark):
    """A passage at the border of two pieces of a long text, and in a short one, goes from both and nothing else does."""
    rng = np.random.default_rng(9)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, head, tail = letters(300), letters(suffix_dedup.BATCH_BYTES - 150), letters(400_000)
    texts = {1: f"{head}-{passage}+{tail}", 2: f"one {passage} two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {d: (len(t), 300, 1, hashlib.sha256(t.replace(passage, "").encode()).hexdigest()) for d, t in texts.items()}
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()} == want


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_of_long_texts_cover_every_window_once():
    text = bytes(np.random.default_rng(1).integers(97, 101, 1000, np.uint8))
    for piece in (64, 999, 5000):
        starts = [w for _, first, n in suffix_dedup.cut_paths(text, 50, 8, piece)
                  for f, c in zip(first.tolist(), n.tolist(), strict=True) for w in range(f, f + c)]
        assert starts == list(range(951))


def naive_order(text):
    suffixes = [text[i:].tolist() for i in range(len(text))]
    order = sorted(range(len(text)), key=suffixes.__getitem__)
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        x, y = suffixes[a], suffixes[b]
        shared.append(next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))
    return order, shared


@pytest.mark.parametrize("tiny", [False, True])
def test_induced_sorting_equals_sorting(tmp_path, monkeypatch, tiny):
    if tiny:  # everything through files
        for name, value in (("BUCKET_ROWS", 4), ("BLOCK", 5), ("HELD_BYTES", 100), ("BASE_ROWS", 0)):
            monkeypatch.setattr(induced_sort, name, value)
        monkeypatch.setattr(induced_sort.BucketQueue.__init__, "__defaults__", (8,))
    rng = np.random.default_rng(2)
    for case in range(60):
        text = rng.integers(1, rng.integers(2, 7), rng.integers(0, 160))
        if case % 3 == 0:
            text = np.repeat(text, rng.integers(1, 12, len(text)))
        text = np.append(text, 0).astype(np.uint8)
        folder = f"{tmp_path}/{case}"
        rows = induced_sort.sort_suffixes(text, int(text.max()) + 1, folder)
        order, shared = induced_sort.merged(text, *rows, folder)
        assert (order.tolist(), shared.tolist()) == naive_order(text)
