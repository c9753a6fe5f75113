import math
import re
import zlib
from collections import Counter

import pytest

from lumenframe.llm import ngram_lm, queries


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", lowered), "</s>"]


def discount(d, c):
    return 0 if c == 0 else d[min(c, 3) - 1]


class Plain:
    def __init__(self, texts):
        seqs = [tokens(t) for t in texts]
        self.words = Counter(w for s in seqs for w in s)
        self.pairs = Counter(p for s in seqs for p in zip(["<s>", *s[:-1]], s, strict=True))
        self.after, self.total = Counter(w for _, w in self.pairs), Counter()
        for (a, _), c in self.pairs.items():
            self.total[a] += c
        ns = lambda table: ngram_lm.discounts(*(sum(c == i for c in table.values()) for i in (1, 2, 3, 4)))
        self.d, self.dw = ns(self.pairs), ns(self.after)

    def lower(self, w):
        even = 1 / (len(self.words) + 1)
        if not self.pairs:
            return even
        rest = sum(discount(self.dw, c) for c in self.after.values()) / len(self.pairs)
        c = self.after[w]
        return (c - discount(self.dw, c)) / len(self.pairs) + rest * even

    def chance(self, a, w):
        if not self.total[a]:
            return self.lower(w)
        c = self.pairs[a, w]
        rest = sum(discount(self.d, n) for (x, _), n in self.pairs.items() if x == a)
        return ((c - discount(self.d, c)) + rest * self.lower(w)) / self.total[a]

    def figures(self, text):
        seq, n, v = tokens(text), sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq)
        score = sum(math.log10(self.chance(a, w)) for a, w in zip(["<s>", *seq[:-1]], seq, strict=True))
        return len(seq), sum(self.words[w] > 0 for w in seq), base, score


TEXTS = [None, "", " \n", "The cat sat on the mat", "the Cat ate", "the dog sat on the dog", "a b a b a b", "é É cat",
         "the cat sat", "the cat sat", "unseen words here", "the the the " * 200, "z" * 3000] + [
         f"the {w} sat on a {w} and the {w} ran" for w in "cat dog fox hen cow".split()]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_scores_match_dictionary_model(spark, parts):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    plain = Plain(TEXTS[:14])
    model = ngram_lm.train(docs.where("doc_id < 14"), parts)
    rows = model.score(docs.repartition(3)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        want = plain.figures(TEXTS[row.doc_id])
        assert (row.n_tokens, row.n_known) == want[:2]
        assert row.base_score == pytest.approx(want[2], rel=1e-9)
        assert row.score == pytest.approx(want[3], rel=1e-9)


def test_chances_add_up():
    plain = Plain(TEXTS[:14])
    for a in ("the", "<s>", "never"):
        assert sum(plain.chance(a, w) for w in [*plain.words, "unknown"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = ngram_lm.train(docs.where("false"))
    assert {r.n_known for r in model.score(docs).collect()} == {0}
    assert model.score(docs.where("false")).collect() == []


def test_query_splits_by_checksum(spark, sf_dir):
    rows = queries.QUERIES["op3_kneser_ney"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    assert len({r.train_tokens for r in rows}) == 1 and all(r.score < 0 for r in rows)
