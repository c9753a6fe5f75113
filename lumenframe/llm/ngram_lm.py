"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the scoring tasks.

Three counts, each a map over texts or tables, a shuffle of packed sorted arrays by part, and a merge per part:

1. words: the vocabulary, a sorted array of word hashes cut into parts by leading bits; a word's id is its rank;
2. bigrams: (id << 32 | id) keys, spread over parts by a hash of the whole key, so frequent words spread too;
3. contexts and continuations: per id how many bigrams begin with it (by count) and how many distinct words precede it.

Parts are files of plain sorted arrays in the cluster's shared folder, which must be mounted on all workers. They
replace themselves whole when a task is repeated. The driver holds one row per part.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, load_array, mix, mounted, save_array, shared_path, text_slices

START = np.uint64(0xFFFFFFFF)  # context of a text's first word
_END_HASH = np.uint64(0xE4D0F7E5)  # stands for the end token among the word hashes
TASK_KEYS = 6_000_000  # keys a counting task gathers before it packs them
PART_KEYS = 3_000_000  # keys a part is planned for
_BLOCK = "part int, keys binary, counts binary"
_MANIFEST = "part int, n long, total long, n1 long, n2 long, n3 long, n4 long"


def _count_runs(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their (weighted) counts."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(weights, heads) if len(heads) else weights


def _pack(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cut counted keys into one row per part."""
    codec = pa.Codec("zstd", 3)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(int(part.max()) + 2)) if len(part) else [0]
    rows: dict[str, list] = {"part": [], "keys": [], "counts": []}
    for p in range(len(edges) - 1):
        own = order[edges[p]:edges[p + 1]]
        if len(own):
            rows["part"].append(p)
            rows["keys"].append(_squeeze(codec, np.diff(keys[own], prepend=np.uint64(0))))
            rows["counts"].append(_squeeze(codec, counts[own].astype(np.uint64)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows["part"], pa.int32()), pa.array(rows["keys"], pa.binary()),
         pa.array(rows["counts"], pa.binary())], ["part", "keys", "counts"])


def _squeeze(codec: pa.Codec, values: np.ndarray) -> bytes:
    """Compress 64-bit values by byte planes; the first eight bytes tell how many there are."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + codec.compress(planes, asbytes=True)


def _expand(block: bytes) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    planes = pa.Codec("zstd").decompress(block[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge the packed blocks that a task has received, one part after the other."""
    blocks: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            blocks.setdefault(row["part"], []).append((row["keys"], row["counts"]))
    for part in list(blocks):
        own = blocks.pop(part)
        yield part, *_count_runs(np.concatenate([np.cumsum(_expand(k), dtype=np.uint64) for k, _ in own]),
                                 np.concatenate([_expand(c) for _, c in own]))


def _counted(keys_of: Callable, part_of: Callable):
    """A mapping task: gather keys of its batches, count them, pack them by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows, texts in text_slices(batch):
                held.append(keys_of(texts))
                size += len(held[-1])
                if size > TASK_KEYS:
                    keys, counts = _count_runs(np.concatenate(held))
                    yield from _pack(keys, counts, part_of(keys))
                    held, size = [], 0
        if held:
            keys, counts = _count_runs(np.concatenate(held))
            yield from _pack(keys, counts, part_of(keys))
    return run


@dataclass(frozen=True)
class Vocabulary:
    folder: str
    parts: int
    bases: tuple[int, ...]  # id of the first word of each part
    tokens: int

    @property
    def size(self) -> int:
        return self.bases[-1]

    def part_of_id(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.bases[1:], np.uint64), ids, side="right").astype(np.int64)


def _part_of_hash(parts: int):
    shift = np.uint64(64 - (parts.bit_length() - 1)) if parts > 1 else None
    return lambda keys: (keys >> shift).astype(np.int64) if shift else np.zeros(len(keys), np.int64)


def _part_of_key(parts: int):
    return lambda keys: (mix(keys) % np.uint64(parts)).astype(np.int64)


def _word_keys(texts: list[bytes]) -> np.ndarray:
    return np.r_[Words(texts, lower=True).hashes, np.full(len(texts), _END_HASH)]


def _array(folder: str, name: str, part: int) -> str:
    return f"{folder}/{name}-{part:06d}"


class Reader:
    """A task's view of the mapped model."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.hashes = [load_array(_array(vocabulary.folder, "word", p), np.uint64) for p in range(vocabulary.parts)]
        self.part_of = _part_of_hash(vocabulary.parts)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each hash in the vocabulary, and whether it is there."""
        found, back = np.unique(hashes, return_inverse=True)
        ids, known = np.zeros(len(found), np.uint64), np.zeros(len(found), bool)
        for p, own in _by_part(self.part_of(found)):
            table = self.hashes[p]
            if len(table):
                at = np.minimum(np.searchsorted(table, found[own]), len(table) - 1)
                known[own] = table[at] == found[own]
                ids[own] = at.astype(np.uint64) + np.uint64(self.vocabulary.bases[p])
        return ids[back], known[back]


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(part) else []
    for start, end in zip(heads, [*heads[1:], len(part)], strict=True):
        yield int(part[order[start]]), order[start:end]


def _sequences(texts: list[bytes], reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every text's word ids, each with its end; ids, known flags, the contexts, and the first token of each text."""
    words = Words(texts, lower=True)
    sizes = words.counts + 1
    first = np.concatenate(([0], np.cumsum(sizes)))
    hashes = np.full(first[-1], _END_HASH)
    is_word = np.ones(first[-1], bool)
    is_word[first[1:] - 1] = False
    hashes[is_word] = words.hashes
    ids, known = reader.ids(hashes)
    before = np.r_[START, ids[:-1]]
    before_known = np.r_[True, known[:-1]]
    before[first[:-1]] = START
    before_known[first[:-1]] = True
    return ids, known, np.where(before_known, before, START - np.uint64(1)), first


def _reduce(blocks: DataFrame, parts: int, run: Callable, schema: str) -> DataFrame:
    return blocks.repartitionById(parts, "part").mapInArrow(run, schema)


def _plan_parts(rows: int) -> int:
    """A power of two, so that leading bits of a hash tell the part."""
    return 1 << max(2, (-(-rows // PART_KEYS) - 1).bit_length())


def train(docs: DataFrame, parts: int | None = None) -> Model:
    """Count the texts of ``docs`` (null: empty) into a model in the shared folder."""
    spark = docs.sparkSession
    folder = mounted(shared_path(spark, "ngram-model"))
    texts = docs.select("text")
    size, starts = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    pair_parts = max(1, -(-(size or 0) // 8 // PART_KEYS))
    parts, pair_parts = (parts, parts + 1) if parts else (_plan_parts((size or 0) // 8), pair_parts)

    def merge_words(batches):
        for part, keys, counts in _gather(batches):
            save_array(_array(folder, "word", part), keys)
            save_array(_array(folder, "count", part), counts)
            yield _manifest(part, len(keys), int(counts.sum()))

    made = {r.part: r for r in _reduce(
        texts.mapInArrow(_counted(_word_keys, _part_of_hash(parts)), _BLOCK), parts, merge_words, _MANIFEST).collect()}
    bases = np.cumsum([0, *(made[p].n if p in made else 0 for p in range(parts))]).tolist()
    for p in set(range(parts)) - set(made):
        save_array(_array(folder, "word", p), np.zeros(0, np.uint64))
        save_array(_array(folder, "count", p), np.zeros(0, np.uint64))
    vocabulary = Vocabulary(folder, parts, tuple(bases), sum(r.total for r in made.values()))

    def count_pairs(batches):
        reader = Reader(vocabulary)

        def pairs(rows: list[bytes]) -> np.ndarray:
            ids, _, before, _ = _sequences(rows, reader)
            return before << np.uint64(32) | ids
        yield from _counted(pairs, _part_of_key(pair_parts))(batches)

    def merge_pairs(batches):
        for part, keys, counts in _gather(batches):
            save_array(_array(folder, "pair", part), keys)
            big = np.flatnonzero(counts >= 255)
            save_array(_array(folder, "pair-count", part), np.minimum(counts, 255).astype(np.uint8))
            save_array(_array(folder, "pair-big-at", part), big.astype(np.uint64))
            save_array(_array(folder, "pair-big", part), counts[big])
            yield from _context_blocks(keys, counts, vocabulary)

    def merge_contexts(batches):
        for part, keys, counts in _gather(batches):
            low = vocabulary.bases[part] if part < parts else int(START)
            length = (vocabulary.bases[part + 1] if part < parts else low + 1) - low
            table = np.zeros((6, length), np.uint64)
            table[keys & np.uint64(7), (keys >> np.uint64(3)) - np.uint64(low)] = counts
            save_array(_array(folder, "context", part), table)
            ends = table[5]
            yield _manifest(part, int(np.count_nonzero(ends)), int(ends.sum()),
                            *(int((ends == i).sum()) for i in range(1, 5)),
                            also=[int(table[i].sum()) for i in range(4)])

    contexts = _reduce(_reduce(texts.mapInArrow(count_pairs, _BLOCK), pair_parts, merge_pairs, _BLOCK),
                       parts, merge_contexts, _MANIFEST + ", c1 long, c2 long, c3 long, c4 long").collect()
    for p in set(range(parts + 1)) - {r.part for r in contexts}:
        length = vocabulary.bases[p + 1] - vocabulary.bases[p] if p < parts else 1
        save_array(_array(folder, "context", p), np.zeros((6, length), np.uint64))
    for name, kind in (("pair", np.uint64), ("pair-count", np.uint8), ("pair-big-at", np.uint64), ("pair-big", np.uint64)):
        for p in range(pair_parts):
            if not os.path.exists(_array(folder, name, p)):
                save_array(_array(folder, name, p), np.zeros(0, kind))
    totals = lambda *names: [sum(r[n] for r in contexts) for n in names]
    d1, d2, d3 = word_discounts = discounts(*totals("n1", "n2", "n3", "n4"))
    continued, n1, n2, pairs = totals("n", "n1", "n2", "total")
    return Model(vocabulary, discounts(*totals("c1", "c2", "c3", "c4")), word_discounts, pair_parts, pairs,
                 d1 * n1 + d2 * n2 + d3 * (continued - n1 - n2), starts)


def _manifest(part: int, n: int, total: int, *ones: int, also: list[int] | None = None) -> pa.RecordBatch:
    values = [n, total, *(ones or (0, 0, 0, 0)), *(also or [])]
    names = ["n", "total", "n1", "n2", "n3", "n4", "c1", "c2", "c3", "c4"][:len(values)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), *(pa.array([v], pa.int64()) for v in values)], ["part", *names])


def _context_blocks(keys: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """What a part of the bigrams adds to each id: bigrams that begin with it by count 1, 2, 3, 4, more (slots 0 to 4,
    the number of distinct followers), and distinct words before it (slot 5). Keys are (id << 3 | slot)."""
    before, after = keys >> np.uint64(32), keys & START
    slot = np.minimum(counts, 5).astype(np.uint64) - np.uint64(1)
    added, n = np.unique(np.r_[before << np.uint64(3) | slot, after << np.uint64(3) | np.uint64(5)], return_counts=True)
    yield from _pack(added, n, vocabulary.part_of_id(added >> np.uint64(3)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; tiny tables get plain ones."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pair_parts: int
    pairs: int  # distinct bigrams
    spared: float  # what the word discounts leave of them
    starts: int  # texts

    def score(self, docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
        """Per text: n_tokens, n_known, base_score and score (log10), after doc_id and the columns of ``also``."""
        kept = ["doc_id", *also]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(self)
            for batch in batches:
                for rows, texts in text_slices(batch):
                    figures = scorer.figures(texts)
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c) for c in kept), *map(pa.array, figures)],
                        [*kept, "n_tokens", "n_known", "base_score", "score"])

        schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
        return docs.select(*kept, "text").mapInArrow(
            run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


class Scorer:
    """Scores texts against the mapped arrays."""

    def __init__(self, model: Model):
        vocabulary = model.vocabulary
        self.model, self.reader = model, Reader(vocabulary)
        folder, parts = vocabulary.folder, vocabulary.parts
        load = lambda name, kind, n: [load_array(_array(folder, name, p), kind) for p in range(n)]
        self.counts, self.pairs = load("count", np.uint64, parts), load("pair", np.uint64, model.pair_parts)
        self.pair_counts = load("pair-count", np.uint8, model.pair_parts)
        self.big_at = load("pair-big-at", np.uint64, model.pair_parts)
        self.big = load("pair-big", np.uint64, model.pair_parts)
        self.contexts = [load_array(_array(folder, "context", p), np.uint64).reshape(6, -1) for p in range(parts + 1)]
        self.part_of_key = _part_of_key(model.pair_parts)

    def figures(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        ids, known, before, first = _sequences(texts, self.reader)
        model, vocabulary = self.model, self.model.vocabulary
        words, back = np.unique(np.where(known, ids, START), return_inverse=True)
        unigram, continuation = np.zeros(len(words)), np.zeros(len(words))
        for p, own in _by_part(vocabulary.part_of_id(words)):
            if p < vocabulary.parts:
                at = (words[own] - np.uint64(vocabulary.bases[p])).astype(np.int64)
                unigram[own] = self.counts[p][at]
                continuation[own] = self.contexts[p][5][at]
        base = np.log10((unigram + 0.1) / (vocabulary.tokens + 0.1 * (vocabulary.size + 1)))[back]
        d1, d2, d3 = model.word_discounts
        cut = np.where(continuation >= 3, d3, np.where(continuation == 2, d2, np.where(continuation == 1, d1, 0.0)))
        lower = self._lower(continuation, cut)[back]
        score = np.log10(self._joint(ids, known, before) + self._back_off(before) * lower)
        add = lambda values: np.add.reduceat(values, first[:-1])
        return np.diff(first), add(known.astype(np.int64)), add(base), add(score)

    def _lower(self, continuation: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Share of a word among all distinct bigrams, the discounted rest spread evenly over words and the unknown."""
        model = self.model
        even = 1 / (model.vocabulary.size + 1)
        if not model.pairs:
            return np.full(len(continuation), even)
        return np.maximum(continuation - cut, 0) / model.pairs + model.spared / model.pairs * even

    def _joint(self, ids: np.ndarray, known: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Discounted share of each bigram in its context."""
        keys, back = np.unique(np.where(known, before << np.uint64(32) | ids, START), return_inverse=True)
        counts = np.zeros(len(keys))
        for p, own in _by_part(self.part_of_key(keys)):
            table = self.pairs[p]
            if len(table):
                at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
                got = self.pair_counts[p][at].astype(np.float64)
                large = np.flatnonzero(got == 255)
                got[large] = self.big[p][np.searchsorted(self.big_at[p], at[large].astype(np.uint64))] if len(large) else 0
                counts[own] = np.where(table[at] == keys[own], got, 0)
        d1, d2, d3 = self.model.pair_discounts
        counts -= np.where(counts >= 3, d3, np.where(counts == 2, d2, np.where(counts == 1, d1, 0.0)))
        total = self._context(before)[0]
        return np.where(total > 0, counts[back] / np.maximum(total, 1), 0.0)

    def _back_off(self, before: np.ndarray) -> np.ndarray:
        total, spared = self._context(before)
        return np.where(total > 0, spared / np.maximum(total, 1), 1.0)

    def _context(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that follow each context, and the mass that the discounts leave."""
        if getattr(self, "_last", None) is not None and self._last[0] is before:
            return self._last[1]
        vocabulary = self.model.vocabulary
        found, back = np.unique(before, return_inverse=True)
        total, spared = np.zeros(len(found)), np.zeros(len(found))
        d1, d2, d3 = self.model.pair_discounts
        for p, own in _by_part(vocabulary.part_of_id(found)):
            at = (found[own] - np.uint64(vocabulary.bases[p])).astype(np.int64) if p < vocabulary.parts else None
            if at is None:  # a text's start, or an unknown word, which nothing has followed
                own, at = own[found[own] == START], 0
                if not len(own):
                    continue
                total[own] = self.model.starts
            else:
                total[own] = self.counts[p][at]
            table = self.contexts[p]
            spared[own] = d1 * table[0][at] + d2 * table[1][at] + d3 * (table[2][at] + table[3][at] + table[4][at])
        self._last = before, (total[back], spared[back])
        return self._last[1]
