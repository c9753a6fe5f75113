"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are plain counts and ratios of a whole text. Trees are grown on a bounded sample of labelled rows with
binned features, and flattened into arrays, through which numpy sends all rows of a batch level by level.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 20_000  # labelled rows that are learned from, at most: those with the smallest hashes
THRESHOLD = 0.3
FEATURES = (
    "words", "chars", "word_length", "long_words", "lines", "words_per_line", "distinct_words", "distinct_pairs",
    "top_word", "top_pair", "upper", "capital_words", "upper_words", "digits", "punctuation", "symbols", "pipes",
    "bangs", "sentence_ends", "symbol_words", "bar_words", "bang_words", "repeats_next", "distinct_lines",
    "other_letters", "packed_size", "links", "braces",
)
_WORD_END_SYMBOL = re.compile(rb"[#$%&*@^~+=<>]\s")
_PUNCTUATION, _SYMBOLS = b".,;:!?'\"()-", b"#$%&*@^~+=<>_\\/[]{}|`"


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_PUNCTUATION, _IS_SYMBOL = _table(_PUNCTUATION), _table(_SYMBOLS)


def statistics(text: bytes) -> list[float]:
    """The FEATURES of one whole text."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    data = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = text.split(b"\n")
    ends = [w[-1] for w in words]
    last = np.bincount(ends, minlength=256) if ends else np.zeros(256, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lowered = text.lower().split()
    codes = np.fromiter(map(hash_of, lowered), np.uint64, len(words)) if words else np.zeros(0, np.uint64)
    counts = np.unique(codes, return_counts=True)[1]
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    pair_counts = np.unique(pairs, return_counts=True)[1]
    upper = int(data[65:91].sum())
    return [
        len(words), len(text), float(lengths.mean()) if words else 0.0, float((lengths > 12).sum()) / n, len(lines),
        len(words) / max(len(lines), 1), len(counts) / n, len(pair_counts) / max(len(pairs), 1),
        float(counts.max()) / n if words else 0.0, float(pair_counts.max()) / max(len(pairs), 1) if len(pairs) else 0.0,
        upper / size, sum(map(_capital, words)) / n, sum(map(bytes.isupper, words)) / n, float(data[48:58].sum()) / size,
        float(data[_IS_PUNCTUATION].sum()) / size, float(data[_IS_SYMBOL].sum()) / size, data[124] / n, data[33] / n,
        float(last[[46, 33, 63]].sum()) / n, float(last[_IS_SYMBOL].sum()) / n, last[124] / n, last[33] / n,
        float((codes[1:] == codes[:-1]).sum()) / n, len(set(lines)) / max(len(lines), 1),
        float(data[128:].sum()) / size, len(zlib.compress(text, 1)) / size, text.count(b"http") / n,
        float(data[[123, 125, 60, 62]].sum()) / size,
    ]


def _capital(word: bytes) -> bool:
    return 65 <= word[0] <= 90


hash_of = zlib.crc32


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node i of tree t asks ``x[feature] <= cut`` and goes to child left or left + 1; leaves stay."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.left[at] + (x[rows, self.feature[at]] > self.cut[at])
            total += self.value[at]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
        ridge: float = 1.0, least: int = 10) -> Trees:
    """Boost logistic loss with binary trees grown level by level from gradient histograms."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    features, cuts, lefts, values, roots = [], [], [], [], []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = x.shape[1]
    columns = np.arange(width) * bins
    margin = np.full(len(y), base)
    grown = 0 if len(y) < 2 * least or y.min() == y.max() else trees
    for _ in range(grown):
        chance = 1 / (1 + np.exp(-margin))
        gradient, curve = chance - y, chance * (1 - chance)
        roots.append(len(features))
        at = np.full(len(y), len(features))  # a node's place in the arrays
        level = [len(features)]
        for table, blank in ((features, 0), (cuts, np.inf), (lefts, len(features)), (values, 0.0)):
            table.append(blank)
        for _ in range(depth):
            order = {node: i for i, node in enumerate(level)}
            place = np.array([order.get(n, -1) for n in range(level[0], level[-1] + 1)])[
                np.clip(at - level[0], 0, level[-1] - level[0])]
            place = np.where((at >= level[0]) & (at <= level[-1]), place, -1)
            live = place >= 0
            index = (place[live, None] * width * bins + columns + binned[live]).ravel()
            shape = (len(level), width, bins)
            sums = lambda w: np.bincount(index, np.repeat(w[live], width), np.prod(shape)).reshape(shape).cumsum(2)  # noqa: B023, E731
            g, h, n = sums(gradient), sums(curve), sums(np.ones(len(y)))
            gain = g ** 2 / (h + ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
            gain[(n < least) | (n[..., -1:] - n < least)] = -np.inf
            following = []
            for i, node in enumerate(level):
                best = int(gain[i].argmax())
                column, slot = divmod(best, bins)
                if not gain[i, column, slot] > 1e-6 or slot >= len(edges[column]):
                    continue
                child = len(features)
                features[node], cuts[node], lefts[node] = column, float(edges[column][slot]), child
                own = at == node
                at[own] = child + (binned[own, column] > slot)
                for side in (0, 1):
                    for table, blank in ((features, 0), (cuts, np.inf), (lefts, child + side), (values, 0.0)):
                        table.append(blank)
                    following.append(child + side)
            if not following:
                break
            level = following
        total_g, total_h = np.bincount(at, gradient, len(features)), np.bincount(at, curve, len(features))
        for node in np.unique(at).tolist():
            values[node] = -rate * float(total_g[node] / (total_h[node] + ridge))
        margin = margin + np.array(values)[at]
    return Trees(np.array(features, np.int64), np.array(cuts, float), np.array(lefts, np.int64), np.array(values, float),
                 np.array(roots, np.int64), depth, base)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))],
            ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Learn from the labelled documents that are ``usable``, at most ``rows`` of them, by smallest hash of doc_id.

    Labels are 0 or 1; documents with none, with conflicting ones, or without doc_id are not learned from. Of several
    documents with one doc_id the one with the smallest statistics counts. Without two classes the share of label
    1 (a half when nothing is labelled) is every text's score.
    """
    sample = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).alias("low"), F.max(label).alias("label")).where("low = label").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "label")
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` ids
    taken = chosen.select("doc_id", F.col("label").cast("int"), "text").mapInArrow(
        _feature_rows, f"doc_id {kind}, label int, x array<double>").groupBy("doc_id", "label").agg(
        F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(taken["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, taken["label"].to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """All columns of ``docs`` and ``quality_score``, from 0 to 1; null and empty texts are scored like others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            x = np.array([statistics(t or b"") for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(trees.scores(x))], [*batch.schema.names, "quality_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, quality_score double")
