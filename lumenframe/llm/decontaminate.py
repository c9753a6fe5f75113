"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single spaces. An item may differ in up to a share of its
characters; cut into one piece more than that budget, at least one piece survives any such differences unchanged.
Short items are one piece, with the spaces at their ends: they must stand there as whole words.
All pieces of all items are searched in a text at once; where one is found, the region that the item would cover is
verified with Myers' bit-parallel edit distance. The benchmark is taken in blocks of bounded size, each a pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ERROR_SHARE = 1 / 16  # edits allowed per character of an item
EXACT_CHARS = 32  # shorter items allow no edit: they count where they stand word for word
BLOCK_CHARS = 8 << 20  # benchmark text that one pass broadcasts at most (one longer item is a block of its own)
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower-case words joined by single spaces, with a space at either end."""
    return f" {_GAPS.sub(' ', (text or '').lower()).strip()} "


@dataclass(frozen=True)
class Pattern:
    item: object
    text: str
    budget: int

    def pieces(self) -> list[tuple[str, int]]:
        """The item cut into budget + 1 nearly equal pieces, with their places."""
        n, parts = len(self.text), self.budget + 1
        edges = [n * i // parts for i in range(parts + 1)]
        return [(self.text[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]


def patterns(items: list[tuple[object, str | None]], share: float = ERROR_SHARE, exact: int = EXACT_CHARS) -> list[Pattern]:
    """The items to search; those without any word (null, blank, signs only) have nothing to search for."""
    found = []
    for item, text in items:
        plain = normal(text)
        size = len(plain) - 2
        if size > 0:
            found.append(Pattern(item, plain, int(size * share) if size >= exact else 0))
    return found


def myers(pattern: str, text: str, bound: int) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any part of ``text``, and where the first such part ends (-1: above
    ``bound``)."""
    m = len(pattern)
    top = 1 << (m - 1)
    full = (1 << m) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = bound + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        plus = (mh << 1 | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds a block of patterns in texts."""

    def __init__(self, block: list[Pattern]):
        import ahocorasick

        self.block = block
        self.pieces = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, p in enumerate(block):
            for piece, at in p.pieces():
                owners.setdefault(piece, []).append((i, at))
        for piece, own in owners.items():
            self.pieces.add_word(piece, (len(piece), own))
        if owners:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(pattern, smallest distance, number of places) of every pattern within its budget."""
        if not self.block:
            return []
        plain = normal(text)
        places: dict[int, set[int]] = {}
        for end, (length, own) in self.pieces.iter(plain):
            for i, at in own:
                places.setdefault(i, set()).add(end + 1 - length - at)
        found = []
        for i, starts in places.items():
            p = self.block[i]
            best, count, covered = p.budget + 1, 0, -1
            for begin in sorted(starts):
                if begin + p.budget <= covered:
                    continue  # the same place, found by another piece
                low = max(begin - p.budget, 0)
                distance, end = myers(p.text, plain[low:begin + len(p.text) + p.budget], p.budget)
                if end >= 0:
                    best, count = min(best, distance), count + 1
                    covered = low + end - len(p.text) + 2 * p.budget
            if count:
                found.append((i, best, count))
        return found


def _match_rows(block, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in batches:
            rows, items, distances, counts = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for p, distance, count in matcher.find(text):
                    rows.append(i)
                    items.append(matcher.block[p].item)
                    distances.append(distance)
                    counts.append(count)
            others = [batch.column(c).take(pa.array(rows, pa.int64())) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(items, item_type), pa.array(distances, pa.int64()), pa.array(counts, pa.int64())],
                [*(c for c in batch.schema.names if c != "text"), "item_id", "distance", "places"])
    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[Pattern]]:
    """The benchmark's patterns in blocks of at most BLOCK_CHARS, read a block at a time."""
    sized = benchmark.select("item_id", "text").where("text is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-2 * total // BLOCK_CHARS))
    for i in range(count):
        held: list[tuple] = []
        size = 0
        for row in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).distinct().toLocalIterator():
            if held and size + len(row.text) > BLOCK_CHARS:
                yield patterns(held)
                held, size = [], 0
            held.append((row.item_id, row.text))
            size += len(row.text)
        yield patterns(held)


def wordless(benchmark: DataFrame) -> DataFrame:
    """The rows of the benchmark that cannot be searched, as nothing is left of them but spaces: null, blank, signs only."""
    return benchmark.where(~F.coalesce(F.col("text").rlike(r"(?U)[\w&&[^_]]"), F.lit(False)))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, places): items found in a text within the budget, with the smallest distance.

    Whole texts are searched; null and empty ones hold nothing. Short items (below
    EXACT_CHARS) must stand there word for word; ``wordless`` gives the items that hold nothing to search. Repeated rows are reported each; so are items that occur twice in the benchmark under different ids.
    Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    doc, item = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc.simpleString()}, item_id {item.simpleString()}, distance long, places long"
    found = None
    for block in _blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(
            _match_rows(spark.sparkContext.broadcast(block), to_arrow_type(item)), schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item of the benchmark."""
    spark = docs.sparkSession

    def keep_rows(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block.value)
            for batch in batches:
                free = [i for i, text in enumerate(batch.column("text").to_pylist()) if not matcher.find(text)]
                yield batch.take(pa.array(free, pa.int64()))
        return run

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(keep_rows(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
