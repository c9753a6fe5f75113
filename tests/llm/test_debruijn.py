import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import debruijn


def plain(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture(window):
    rng = np.random.default_rng(3)
    word = lambda n, v: " ".join(f"w{i}" for i in rng.integers(0, v, n))
    passage, license_ = word(window + 15, 500), word(window, 500)
    texts = [None, "", "  \n", "one two", word(300, 3), word(window * 3, 900), passage, license_]
    for i in range(12):
        cut = passage.split()[i % 5:window + 3 + i]
        texts.append(f"{word(20, 900)} {' '.join(cut)} {word(i * 3, 900)}")
        texts.append(f"{word(5, 900)}\t{license_}\n{word(9, 900)} {license_ if i == 3 else ''}")
    base = word(200, 5000)
    texts += [base, base, base.replace(" w", " v", 1), " ".join(base.split()[40:]), "Shti " * 100, "Shti " * 50,
              " ".join(base.split()[:90] + ["edit"] + base.split()[91:]), base.upper()]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (5, "clash of ids")]


@pytest.mark.parametrize(("window", "k"), [(35, 8), (6, 3), (3, 3)])
def test_matches_brute_force(spark, window, k):
    rows = fixture(window)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, path int")
    got = debruijn.remove_repeats(docs, window, k).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, window)


def test_empty_table(spark):
    assert debruijn.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_leftmost_minimum():
    values = np.array([3, 1, 2, 1, 1, 5, 0], np.uint64)
    best, at = debruijn._leftmost_minimum(values, 3)
    assert at.tolist() == [1, 1, 3, 3, 6] and best.tolist() == [1, 1, 1, 1, 0]
