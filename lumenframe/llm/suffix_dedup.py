"""Long byte strings that occur again, found by suffix arrays of shards that induced sorting builds in files.

A window is ``window`` bytes of one text. The smallest hash among its ``k``-byte strings (leftmost on ties) is its
anchor; neighbouring windows of one anchor form a path. Equal windows have equal anchors, so

* a path whose anchor occurs only once shares no window with anything else;
* a path that occurs twice (by two 64-bit hashes together, of anchor and content) repeats as a whole;
* the different paths of an anchor go as texts to one shard, whose suffix array (``induced_sort``) tells which of their
  windows agree: neighbours with a common prefix of a window or more.

Anchors of very many different paths are dealt out further by anchors of ``HOT_K`` bytes within their paths. Counts are
joined back as tables of their own, so that the join can split a hot anchor's rows. Cutting a path, as very long texts
do, is harmless: its parts are then different paths of one anchor.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .induced_sort import BLOCK, room, seams, sort_suffixes
from .shared import BATCH_BYTES, keep, mix, mounted, shared_path, text_slices

ANCHOR_BYTES, HOT_K = 32, 160
HOT_WAYS = 100_000  # different paths of an anchor from which on they are dealt out further
SHARD_BYTES = 4 << 20  # path text for which a shard is planned; a hot anchor may exceed it
REPEATED, COMPARED, SPLIT = 1, 2, 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))
_PLACE = np.dtype([("start", "<i8"), ("size", "<i8"), ("at", "<i8"), ("weight", "<i8"), ("key", "V16")])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in every run of ``width``, by doubling."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def cut_paths(text: bytes, window: int, k: int, piece: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Paths of a text: (anchors, first windows, numbers of windows), of one piece of the text at a time."""
    for begin in range(0, max(0, len(text) - window + 1), piece):
        data = np.frombuffer(text, np.uint8, min(len(text) - begin, piece + window - 1), begin)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SPREAD[data] * _powers(_BASE, len(data)), out=sums[1:])
        mers = mix((sums[k:] - sums[:-k]) * _powers(_BACK, len(data) - k + 1))
        at = _smallest(mers, window - k + 1)
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        yield mers[at[heads]].view(np.int64), heads + begin, np.diff(np.concatenate([heads, [len(at)]]))


def _content(text: bytes, start: int, size: int, window: int) -> int:
    return int.from_bytes(hashlib.blake2b(text[start:start + size + window - 1], digest_size=8).digest(), "little", signed=True)


def _path_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                keys, anchors, contents = [], [], []
                for key, text in zip(rows.column("key").to_pylist(), texts, strict=True):
                    for anchor, start, size in cut_paths(text, window, k):
                        keys += [key] * len(anchor)
                        anchors += anchor.tolist()
                        contents += [_content(text, s, n, window) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                table = pa.table([pa.array(keys, pa.binary()), pa.array(anchors, pa.int64()), pa.array(contents, pa.int64())],
                                 ["key", "anchor", "path"]).group_by(["key", "anchor", "path"]).aggregate([([], "count_all")])
                yield from table.rename_columns(["key", "anchor", "path", "n"]).to_batches()
    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, maximal runs of them, and the digest of the others."""
    digest, at, gone = hashlib.sha256(), 0, 0
    for start, end in spans:
        digest.update(memoryview(text)[at:start])
        at, gone = end, gone + end - start
    digest.update(memoryview(text)[at:])
    return gone, len(spans), digest.hexdigest()


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SPANS = "array<struct<s:long,e:long>>"
_MARKED = f"{_RESULT}, key binary, text string, covered {_SPANS}, open array<struct<anchor:long,at:long,weight:int,body:binary>>"


def _mark_rows(window: int, k: int, schema: pa.Schema):
    """Settle texts whose paths decide everything; of the others give the paths that are still to be compared."""
    def bodies(text: bytes, flag: int, anchor: int, start: int, size: int) -> Iterator[dict]:
        weight, body = 2 if flag & REPEATED else 1, text[start:start + size + window - 1]
        if not flag & SPLIT:
            yield {"anchor": anchor, "at": start, "weight": weight, "body": body}
            return
        for inner, first, count in cut_paths(body, window, min(HOT_K, window)):
            for a, s, n in zip(inner.tolist(), first.tolist(), count.tolist(), strict=True):
                yield {"anchor": a, "at": start + s, "weight": weight, "body": body[s:s + n + window - 1]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                out = {name: [] for name in schema.names[1:]}
                for key, text, found in zip(rows.column("key").to_pylist(), texts, rows.column("paths").to_pylist(), strict=True):
                    flags = {(x["anchor"], x["path"]): x["flag"] for x in found or ()}
                    covered, opened, given = [], [], set()
                    for anchors, starts, sizes in cut_paths(text, window, k) if flags else ():
                        for a, s, n in zip(anchors.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                            path = (a, _content(text, s, n, window))
                            flag = flags.get(path, 0)
                            if flag & REPEATED:
                                covered.append((s, s + n + window - 1))
                            if flag & COMPARED and path not in given:
                                given.add(path)
                                opened += bodies(text, flag, a, s, n)
                    spans = _merged(covered)
                    gone, runs, digest = (None, None, None) if opened else _kept(text, spans)
                    row = (len(text), gone, runs, digest, key, text.decode() if opened else None,
                           [{"s": s, "e": e} for s, e in spans] if opened else None, opened or None)
                    for name, value in zip(schema.names[1:], row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(pa.array(out[f.name], f.type) for f in list(schema)[1:])], schema=schema)
    return run


def _finish_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                more = zip(texts, rows.column("covered").to_pylist(), rows.column("found").to_pylist(), strict=True)
                done = [(len(t), *_kept(t, _merged([(x["s"], x["e"]) for x in (*c, *(f or ()))]))) for t, c, f in more]
                columns = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(
                    pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)
    return run


def repeated_windows(text: np.ndarray, window: int, folder: str) -> np.ndarray:
    """Marks (one byte a position) of suffixes that share ``window`` symbols with another one.

    The text holds symbols below 256 and ends in its only 0.
    """
    ascending, descending = sort_suffixes(text, 256, folder)
    marks = room(f"{folder}/marks", np.uint8, len(text))
    for table in (ascending, descending):
        for i in range(0, len(table), BLOCK):
            rows = table[max(i - 1, 0):i + BLOCK]
            near = np.flatnonzero(rows[1:, 2] >= window) + 1
            marks[rows[near, 1]] = marks[rows[near - 1, 1]] = 1
    a, b, share = seams(text, ascending, descending)
    marks[a[share >= window]] = marks[b[share >= window]] = 1
    return marks


def _shard_rows(window: int, root: str):
    """Sort the suffixes of one shard's paths and give the spans of their repeated windows."""
    def spans(marks: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(places), 1 << 14):
            part = places[i:i + (1 << 14)]
            base, end = int(part["start"][0]), int(part["start"][-1] + part["size"][-1])
            inside = np.zeros(end - base + 2, np.int8)  # windows that lie in one path of weight 1
            wanted = part[part["weight"] == 1]
            np.add.at(inside, wanted["start"] - base + 1, 1)
            np.add.at(inside, wanted["start"] + wanted["size"] - window + 1 - base + 1, -1)
            hit = (np.cumsum(inside) > 0) & np.concatenate([[False], marks[base:end] > 0, [False]])
            edges = np.flatnonzero(hit[1:] != hit[:-1]) + base
            first, last = edges[0::2], edges[1::2]
            owner = part[np.searchsorted(part["start"], first, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([bytes(x) for x in owner["key"]], pa.binary()), pa.array(owner["at"] + first - owner["start"]),
                 pa.array(owner["at"] + last - owner["start"] + window - 1)], ["key", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, size = f"{root}/{uuid.uuid4().hex}", 0
        try:
            os.makedirs(folder)
            with open(f"{folder}/text", "wb") as text, open(f"{folder}/places", "wb") as places:
                for batch in batches:
                    for key, at, weight, body in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "weight", "body")), strict=True):
                        text.write((np.frombuffer(body, np.uint8) + 2).data)
                        text.write(b"\x01")
                        places.write(np.array((size, len(body), at, weight, key), _PLACE).tobytes())
                        size += len(body) + 1
                text.write(b"\x00")
            if size:
                marks = repeated_windows(np.memmap(f"{folder}/text", np.uint8, "r"), window, folder)
                yield from spans(marks, np.memmap(f"{folder}/places", _PLACE, "r"))
        finally:
            shutil.rmtree(folder, ignore_errors=True)
    return run


def row_key() -> Column:
    """128 bits of doc_id and text, nulls told apart from empty values."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat_ws("\0", *parts)))


def remove_repeats(docs: DataFrame, window: int = 200, k: int = ANCHOR_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): texts as UTF-8 without all windows that occur elsewhere.

    A window is ``window`` bytes of one text; it repeats if its bytes also start anywhere else, in the same text
    included, overlaps too. All windows are judged on the input; ``n_spans`` counts maximal removed runs. Null texts
    count as empty; empty and short ones lose nothing. A row repeated exactly is an occurrence of its own; rows without
    doc_id are treated like others; other columns are ignored; an empty table gives an empty one. Texts are read whole,
    very long ones in pieces.
    """
    spark = docs.sparkSession
    root = mounted(shared_path(spark, "suffix-shards"))
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    paths = keep(keyed.select("key", "text").mapInArrow(_path_rows(window, k), "key binary, anchor long, path long, n long"), "byte-paths")
    often = keep(paths.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"), "often-anchors")
    shared = keep(paths.join(often, "anchor"), "shared-paths")
    distinct = keep(shared.groupBy("anchor", "path").agg(F.sum("n").alias("total"), F.min("key").alias("owner")), "distinct-paths")
    # Where all paths of an anchor occur twice they are settled without a comparison.
    ways = keep(distinct.groupBy("anchor").agg(
        F.count("*").alias("ways"), F.count(F.when(F.col("total") == 1, 1)).alias("single")), "ways")
    known = keep(distinct.join(ways, "anchor").where("total > 1 or ways > 1"), "known-paths")
    compared = (F.col("ways") > 1) & (F.col("single") > 0) & (F.col("owner") == F.col("key"))
    flagged = shared.join(known, ["anchor", "path"]).select("key", "anchor", "path", (
        F.when(F.col("total") > 1, REPEATED).otherwise(0) + F.when(compared, COMPARED).otherwise(0)
        + F.when(compared & (F.col("ways") > HOT_WAYS), SPLIT).otherwise(0)).alias("flag")).where("flag > 0").distinct()
    lists = flagged.groupBy("key").agg(F.collect_list(F.struct("anchor", "path", "flag")).alias("paths"))

    own = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
    arrow = {ddl: to_arrow_schema(StructType.fromDDL(own + ddl)) for ddl in (_MARKED, _RESULT)}
    marked = keep(keyed.join(lists, "key", "left").select("doc_id", "key", "text", "paths").mapInArrow(
        _mark_rows(window, k, arrow[_MARKED]), own + _MARKED), "marked-texts")
    # A text that occurs in several rows has one path list; its bodies are equal, and its paths weigh two.
    waiting = marked.where("open is not null")
    bodies = waiting.select("key", F.explode("open").alias("o")).select("key", "o.*")
    total = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    found = bodies.repartition(shards, "anchor").mapInArrow(_shard_rows(window, root), "key binary, s long, e long")
    spans = found.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    finished = waiting.join(spans, "key", "left").select("doc_id", "text", "covered", "found").mapInArrow(
        _finish_rows(arrow[_RESULT]), own + _RESULT)
    return marked.where("open is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(finished)
