"""Long repeated spans by compaction of the token k-mer graph.

A window of ``window`` words holds window - k + 1 k-mers; the smallest by hash (leftmost on ties) is its anchor.
Neighbouring windows with the same anchor form a path: its k-mers have one way in and one way out as far as
windows through that anchor go, so the whole path is one row (anchor, path hash) instead of one row per k-mer.
Equal windows have equal anchors, hence:

* a window whose anchor occurs on one path only, once in the corpus, occurs nowhere else;
* a path that occurs twice repeats with all its windows;
* where an anchor has several different paths (a branching node), the windows of those paths are compared one by one.

Spark joins and counts do each of these steps; coordinates then mark the words to remove in the source texts.
Paths are known by two 64-bit hashes together (anchor and content), windows likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, keep, mix, text_slices

ANCHOR_WORDS = 8
REPEATED, COMPARED = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


class Paths:
    """The windows of several texts as paths: rows of ``doc``, ``anchor``, ``hash``, first window and their number."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        words = Words(texts, lower=False)
        self.first, self.counts, self.window = words.first, words.counts, window
        self.values = words.hashes
        n = len(self.values)
        width = window - k + 1
        if n < window:
            none = np.zeros(0, np.int64)
            self.doc, self.start, self.size, self.anchor, self.hash = none, none, none, none, none
            return
        mers = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            mers = mers * _BASE + self.values[j:n - k + 1 + j]
        mers = mix(mers)
        best, at = _leftmost_minimum(mers, width)
        doc = np.repeat(np.arange(len(texts)), self.counts)[:len(at)]
        position = np.arange(len(at))
        inside = position + window <= self.first[1:][doc]
        position, at, best, doc = position[inside], at[inside], best[inside], doc[inside]
        heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else position
        self.start, self.doc = position[heads], doc[heads]
        self.size = np.diff(np.r_[heads, len(at)])
        self.anchor = best[heads].view(np.int64)
        self.hash = self.spans(self.start, self.start + self.size + window - 1).view(np.int64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [starts, ends)."""
        if not hasattr(self, "_sums"):
            n = len(self.values)
            self._back = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), n + 1)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(self.values ^ _BASE) * _powers(_BASE, n), out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts] + (ends - starts).astype(np.uint64))


def _leftmost_minimum(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value and its leftmost place in every run of ``width`` values, by doubling."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        first = left <= right
        best, at = np.where(first, left, right), np.where(first, at[:-step], at[step:])
        span += step
    return best, at


def _path_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                paths = Paths(texts, window, k)
                order = np.lexsort((paths.hash, paths.anchor, paths.doc))
                doc, anchor, content = paths.doc[order], paths.anchor[order], paths.hash[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                                           | (content[1:] != content[:-1])]) if len(doc) else doc
                key = rows.column("key").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[doc[new]], pa.int64()), pa.array(anchor[new], pa.int64()),
                     pa.array(content[new], pa.int64()),
                     pa.array(np.diff(np.r_[new, len(doc)]), pa.int64())], ["key", "anchor", "path", "n"])
    return run


def _clean(text: bytes, marks: np.ndarray) -> tuple[int, str]:
    """How many words the marks cover, and the digest of the others."""
    words = text.split()
    if not marks.any():
        return 0, hashlib.sha256(b" ".join(words)).hexdigest()
    kept = np.flatnonzero(~marks)
    return len(words) - len(kept), hashlib.sha256(b" ".join([words[j] for j in kept.tolist()])).hexdigest()


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


_MARKED = ("doc_id {id}, key long, n_words long, n_removed long, kept_sha256 string, text string, "
           "covered array<struct<s:int,e:int>>, open array<struct<anchor:long,hash:long,at:int,weight:int>>")


def _mark_rows(window: int, k: int, schema: pa.Schema):
    """Settle texts whose paths decide everything; of the others give the windows that are still to be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                paths = Paths(texts, window, k)
                begin = np.searchsorted(paths.doc, np.arange(len(texts) + 1))
                found = rows.column("paths").to_pylist()
                keys, ids = rows.column("key"), rows.column("doc_id")
                out = {name: [] for name in schema.names[2:]}
                for i in range(len(texts)):
                    flags = {(x["anchor"], x["path"]): x["flag"] for x in found[i] or ()}
                    first, count = int(paths.first[i]), int(paths.counts[i])
                    own = slice(begin[i], begin[i + 1])
                    flag = np.zeros(own.stop - own.start, np.int64)
                    if flags:
                        flag = np.array([flags.get(x, 0) for x in zip(
                            paths.anchor[own].tolist(), paths.hash[own].tolist(), strict=True)], np.int64)
                    start, size = paths.start[own] - first, paths.size[own]
                    again = (flag & REPEATED) > 0
                    s, e = start[again], start[again] + size[again] + window - 1
                    compare = np.flatnonzero(flag & COMPARED)
                    out["n_words"].append(count)
                    settled = not len(compare)
                    marks = _cover(count, s, e)
                    gone, digest = _clean(texts[i], marks) if settled else (None, None)
                    out["n_removed"].append(gone)
                    out["kept_sha256"].append(digest)
                    out["text"].append(None if settled else texts[i].decode())
                    out["covered"].append(None if settled else [
                        {"s": int(a), "e": int(b)} for a, b in zip(s, e, strict=True)])
                    windows = []
                    for j in compare.tolist():
                        at = np.arange(start[j], start[j] + size[j])
                        hashes = paths.spans(at + first, at + first + window).view(np.int64)
                        anchor, weight = int(paths.anchor[own][j]), 2 if flag[j] & REPEATED else 1
                        windows += [{"anchor": anchor, "hash": h, "at": p, "weight": weight}
                                    for h, p in zip(hashes.tolist(), at.tolist(), strict=True)]
                    out["open"].append(windows or None)
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, *(pa.array(out[f.name], f.type) for f in list(schema)[2:])], schema=schema)
    return run


def _finish_rows(window: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                counts = rows.column("n_words").to_pylist()
                covered, more = rows.column("covered").to_pylist(), rows.column("positions").to_pylist()
                gone, digests = [], []
                for i, n in enumerate(counts):
                    extra = np.array(more[i] or [], np.int64)
                    marks = _cover(n, np.r_[np.array([x["s"] for x in covered[i]], np.int64), extra],
                                   np.r_[np.array([x["e"] for x in covered[i]], np.int64), extra + window])
                    removed, digest = _clean(texts[i], marks)
                    gone.append(removed)
                    digests.append(digest)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("n_words"), pa.array(gone, pa.int64()), pa.array(digests)],
                    schema=schema)
    return run


def remove_repeats(docs: DataFrame, window: int = 35, k: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words left once all windows that occur elsewhere are taken out.

    A window is ``window`` consecutive words of one text; it repeats if its words also start anywhere else, in the
    same text included. All windows are judged on the input. Null, empty and short texts keep their words; a row
    repeated exactly is an occurrence of its own; rows without doc_id are treated like others; other columns are
    ignored. Texts are processed whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    paths = keep(keyed.select("key", "text").mapInArrow(
        _path_rows(window, k), "key long, anchor long, path long, n long"), "paths")
    # Counts are tables of their own before they are joined back: the joins then split a hot anchor's rows.
    often = keep(paths.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"), "often")
    shared = keep(paths.join(often, "anchor"), "shared-paths")
    distinct = keep(shared.groupBy("anchor", "path").agg(
        F.sum("n").alias("total"), F.min("key").alias("owner")), "distinct-paths")
    branching = keep(distinct.groupBy("anchor").agg(F.count("*").alias("ways")), "branching")
    known = keep(distinct.join(branching, "anchor"), "known-paths")
    flagged = shared.join(known, ["anchor", "path"]).select(
        "key", "anchor", "path",
        (F.when(F.col("total") > 1, REPEATED).otherwise(0)
         + F.when((F.col("ways") > 1) & ((F.col("total") == 1) | (F.col("owner") == F.col("key"))), COMPARED)
         .otherwise(0)).alias("flag"),
    ).where("flag > 0").distinct()
    lists = flagged.groupBy("key").agg(F.collect_list(F.struct("anchor", "path", "flag")).alias("paths"))

    schema = _MARKED.format(id=docs.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    marked = keep(keyed.join(lists, "key", "left").select("doc_id", "key", "text", "paths").mapInArrow(
        _mark_rows(window, k, arrow), schema), "marked")
    opened = marked.where("open is not null").select("key", F.explode("open").alias("w")).select(
        "key", "w.anchor", "w.hash", "w.at", "w.weight")
    seen = opened.groupBy("anchor", "hash").agg(F.sum("weight").alias("total")).where("total > 1")
    positions = opened.where("weight = 1").join(seen, ["anchor", "hash"]).groupBy("key").agg(
        F.collect_set("at").alias("positions"))
    result = "doc_id, n_words, n_removed, kept_sha256"
    final = schema.split(", key")[0] + ", n_words long, n_removed long, kept_sha256 string"
    waiting = marked.where("open is not null").join(positions, "key", "left").select(
        "doc_id", "n_words", "text", "covered", "positions")
    finished = waiting.mapInArrow(_finish_rows(
        window, to_arrow_schema(docs.sparkSession.createDataFrame([], final).schema)), final)
    return marked.where("open is null").selectExpr(*result.split(", ")).unionByName(finished)
