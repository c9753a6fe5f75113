"""Packing into windows by Karmarkar-Karp multiway differencing.

A document's ids, closed by the end id, are cut into full windows and one rest. Rests are packed: every rest is a
partition of one piece and empty places; the two partitions with the largest imbalance are merged with their
largest places on the other's smallest, until one partition, with near-equal windows, is left. The number of
windows starts at the tokens over the capacity and rises whenever a window exceeds it. So that windows can come out
near-equal, some rests are first cut into grains (``GRAINS`` per window planned), which the merging places last.

Tokens are counted and checked once, in the pass that reads the texts; what is packed is a row per piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import keep, text_slices
from .tokens import WordTable, word_table

CAPACITY = 2048
END_ID = 1
GROUP = 1024  # rests packed together
GRAINS = (64, 16)  # token lengths of the grains cut for each window
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def _cut_rows(table: WordTable, capacity: int, end: int):
    """Pieces of each document: full windows, the grains it gives, and its rest."""
    closing = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = table.reader()
        given = 0.0
        for batch in batches:
            for rows, texts in text_slices(batch):
                at, starts, lengths, sums, sizes = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids = ids + closing
                    n = len(ids) // 4
                    whole = n - n % capacity
                    cuts = list(range(0, whole, capacity))
                    given += (n - whole) / capacity  # windows that the rests so far will need
                    position = whole
                    if given >= 1 and n - position > 2 * sum(GRAINS):
                        cuts.append(position)
                        position = n
                        while given >= 1 and position - sum(GRAINS) > whole:
                            for grain in GRAINS:
                                position -= grain
                                cuts.append(position)
                            given -= 1
                    elif position < n:
                        cuts.append(position)
                    cuts.sort()
                    for start, stop in zip(cuts, [*cuts[1:], n], strict=True):
                        at.append(i)
                        starts.append(start)
                        lengths.append(stop - start)
                        sums.append(zlib.crc32(ids[4 * start:4 * stop]))
                        sizes.append(n)
                doc = rows.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [doc, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, sizes))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """Window of each piece when pieces are split into ``windows`` near-equal sums by largest differencing."""
    # A partition is its windows' sums, largest first, and the merge-tree node in each; empty windows are not listed.
    heap: list = []
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, n in enumerate(lengths.tolist()):
        parts[i] = np.array([n], np.int64), np.array([i], np.int64)
        heap.append((-n, i))
    heapq.heapify(heap)
    joins: list[np.ndarray] = []
    nodes = len(lengths)
    name = nodes
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums_a, nodes_a = parts.pop(a)
        sums_b, nodes_b = parts.pop(b)
        ka, kb = len(sums_a), len(sums_b)
        both = max(0, ka + kb - windows)  # only filled windows are listed; empty ones take the other's first
        sums = np.concatenate([sums_a[:ka - both], sums_a[ka - both:] + sums_b[kb - both:][::-1], sums_b[:kb - both]])
        tree = np.concatenate([nodes_a[:ka - both], np.arange(nodes, nodes + both), nodes_b[:kb - both]])
        if both:
            joins.append(np.stack([nodes_a[ka - both:], nodes_b[kb - both:][::-1]], axis=1))
            nodes += both
        order = np.argsort(-sums, kind="stable")
        sums, tree = sums[order], tree[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        parts[name] = sums, tree
        heapq.heappush(heap, (-spread, name))
        name += 1
    (_, last), = heap
    window = np.full(nodes, -1, np.int64)
    window[parts[last][1]] = np.arange(len(parts[last][1]))
    merged = np.concatenate(joins) if joins else np.zeros((0, 2), np.int64)
    for node in range(len(merged) - 1, -1, -1):  # parents were made after their children
        window[merged[node]] = window[len(lengths) + node]
    return window[:len(lengths)]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each piece (all at most ``capacity``): differencing into as many windows as the tokens fill at least.

    While a window exceeds the capacity the count rises, in doubling steps; the counts that were passed over are
    then bisected down to one that fits next to one that does not.
    """
    def fitting(windows: int) -> np.ndarray | None:
        window = differencing(lengths, windows)
        return window if np.bincount(window, lengths, windows).max() <= capacity else None

    windows, step = max(1, -(-int(lengths.sum()) // capacity)), 1
    failed = windows - 1
    while (best := fitting(windows)) is None:
        failed, windows, step = windows, windows + step, 2 * step
    while windows - failed > 1:
        middle = (failed + windows) // 2
        if (window := fitting(middle)) is None:
            failed = middle
        else:
            windows, best = middle, window
    return best


def _pack_rows(capacity: int):
    """Pack a partition's rests in groups of GROUP rows; sequence numbers are unique over partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = (TaskContext.get().partitionId() + 1) << 36
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(table: pa.Table) -> pa.RecordBatch:
            nonlocal sequence
            lengths = table["length"].to_numpy()
            window = pack(lengths, capacity)
            order = np.argsort(window, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            heads = np.flatnonzero(np.r_[True, np.diff(window[order]) > 0])
            offset = np.empty(len(order), np.int64)
            offset[order] = before - np.repeat(before[heads], np.diff(np.r_[heads, len(order)]))
            out = table.append_column("sequence_id", pa.array(window + sequence)).append_column("offset", pa.array(offset))
            sequence += int(window.max()) + 1
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * GROUP:
                table = pa.Table.from_batches(held)
                while table.num_rows >= 2 * GROUP:
                    yield settle(table.slice(0, GROUP))
                    table = table.slice(GROUP)
                held, size = table.to_batches(), table.num_rows
        if size:
            yield settle(pa.Table.from_batches(held))
    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and ``end_id``; null and empty texts are that id alone. Every id lies in one piece,
    every sequence holds at most ``capacity`` ids without gaps. Repeated rows and rows without doc_id are packed
    like any other; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = keep(docs.select("doc_id", "text").mapInArrow(
        _cut_rows(word_table(docs, tokenizer), capacity, end_id), f"doc_id {kind}, {_PIECE}"), "pieces")
    rests = pieces.where(F.col("length") < capacity)
    tasks = max(1, rests.count() // (8 * GROUP))
    packed = rests.repartition(tasks).mapInArrow(
        _pack_rows(capacity), f"doc_id {kind}, {_PIECE}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(packed)
