"""Token ids of whole texts, encoded once per distinct word of the collection.

The vocabulary drops white space and no token crosses it, so a text's ids are its words' ids, one after the other.
Spark collects the distinct words by hash, each is encoded once, and the tasks that read texts look the ids up in
sorted, memory-mapped arrays of the shared folder. Texts that hold an added token's marker are encoded whole, and so
is every text of a tokenizer for which words do not stand alone.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, load_array, mounted, save_array, shared_path, text_slices

TASK_WORDS = 600_000  # distinct words that a task holds before it hands them on
PART_BYTES = 24 << 20  # text that a part of the table is planned for


def default_tokenizer() -> str:
    """Path of the word-level vocabulary that the box offers; operators take any path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ByteEncoder:
    """A byte-level BPE given by ranks and a splitting pattern; ids of texts as little-endian 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            yield self.encoding.encode_to_numpy(text.decode(), disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def load_byte_encoder(ranks_path: str, pattern: str) -> ByteEncoder:
    """The tokenizer of a file, loaded once in a worker for all its tasks."""
    return ByteEncoder(ranks_path, pattern)


def default_byte_encoder() -> Callable[[], ByteEncoder]:
    """The box's byte-level vocabulary; its id 50256 is free."""
    import public_tokenizers

    return partial(load_byte_encoder, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


class Encoder:
    """The tokenizer itself, giving little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and threads keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.markers = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = ids("One two.\n\t three ") == ids("One") + ids("two.") + ids("three") and ids("a") == ids(" a")

    def splits(self, text: bytes) -> bool:
        """Whether the text's ids are those of its words."""
        return self.by_word and not any(m in text for m in self.markers)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """The tokenizer of a file, loaded once in a worker for all its tasks."""
    return Encoder(path)


def _part(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _distinct_rows(path: str, bits: int):
    """A task's distinct words, packed by part."""
    def pack(words: set[bytes]) -> pa.RecordBatch:
        listed = list(words)
        part = _part(Words([b" ".join(listed)], lower=False).hashes, bits)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange((1 << bits) + 1))
        codec, rows = pa.Codec("zstd", 1), []
        for p in range(1 << bits):
            text = b" ".join([listed[i] for i in order[edges[p]:edges[p + 1]].tolist()])
            rows.append(len(text).to_bytes(8, "little") + codec.compress(text, asbytes=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(1 << bits), pa.int32()), pa.array(rows, pa.binary())], ["part", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = load_encoder(path), set()
        for batch in batches:
            for _, texts in text_slices(batch):
                for text in texts:
                    if encoder.splits(text):
                        held.update(text.split())
                if len(held) > TASK_WORDS:
                    yield pack(held)
                    held = set()
        if held:
            yield pack(held)
    return run


def _table_rows(path: str, folder: str):
    """Encode each distinct word of a part once and store the part as sorted arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, parts = load_encoder(path), {}
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["part"], []).append(row["words"])
        for part in list(parts):
            words: set[bytes] = set()
            for block in parts.pop(part):
                size = int.from_bytes(block[:8], "little")
                words.update(pa.Codec("zstd").decompress(block[8:], size, asbytes=True).split())
            listed = list(words)
            hashes = Words([b" ".join(listed)], lower=False).hashes
            order = np.argsort(hashes)
            lengths, ids = [], []
            for start in range(0, len(order), 1024):
                for coded in encoder.whole([listed[i].decode() for i in order[start:start + 1024].tolist()]):
                    lengths.append(len(coded))
                    ids.append(coded)
            save_array(f"{folder}/hash-{part:06d}", hashes[order])
            save_array(f"{folder}/end-{part:06d}", np.cumsum(np.array(lengths, np.int64)))
            save_array(f"{folder}/ids-{part:06d}", np.concatenate(ids) if ids else np.zeros(0, np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])
    return run


@dataclass(frozen=True)
class WordTable:
    """Where the ids of a collection's words are."""

    tokenizer: str
    folder: str
    bits: int

    def reader(self) -> TableEncoder:
        return TableEncoder(self)


def word_table(docs: DataFrame, tokenizer: str) -> WordTable:
    """Encode the distinct words of all texts of ``docs`` into a table in the shared folder."""
    spark = docs.sparkSession
    folder = mounted(shared_path(spark, "word-ids"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, (-(-size // PART_BYTES) - 1).bit_length())
    made = docs.select("text").mapInArrow(_distinct_rows(tokenizer, bits), "part int, words binary").repartitionById(
        1 << bits, "part").mapInArrow(_table_rows(tokenizer, folder), "part int").collect()
    for part in set(range(1 << bits)) - {r.part for r in made}:
        for name in ("hash", "end", "ids"):
            save_array(f"{folder}/{name}-{part:06d}", np.zeros(0, np.uint8))
    return WordTable(tokenizer, folder, bits)


class TableEncoder:
    """Ids of texts as little-endian 32-bit bytes, exactly as the tokenizer gives them for the whole text."""

    def __init__(self, table: WordTable):
        self.encoder, self.bits = load_encoder(table.tokenizer), table.bits
        load = lambda name, kind: [
            load_array(f"{table.folder}/{name}-{p:06d}", kind) for p in range(1 << table.bits)]
        self.hashes, self.ends, self.ids = load("hash", np.uint64), load("end", np.int64), load("ids", np.uint32)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text in turn."""
        whole = [not self.encoder.splits(t) for t in texts]
        words = Words([b"" if w else t for t, w in zip(texts, whole, strict=True)], lower=False)
        distinct, back = np.unique(words.hashes, return_inverse=True)
        local, start, length = self._lookup(distinct)
        lengths = length[back]
        end = np.concatenate(([0], np.cumsum(lengths)))
        ids = local[np.repeat(start[back] - end[:-1], lengths) + np.arange(end[-1])]
        edges = end[words.first]
        for i, text in enumerate(texts):
            if whole[i]:
                yield self.encoder.whole([text.decode()])[0].tobytes()
            else:
                yield ids[edges[i]:edges[i + 1]].tobytes()

    def _lookup(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of sorted distinct words one after the other, with each word's start and length."""
        edges = np.searchsorted(_part(distinct, self.bits), np.arange((1 << self.bits) + 1))
        pieces, lengths = [np.zeros(0, np.uint32)], np.zeros(len(distinct), np.int64)
        for p in range(1 << self.bits):
            own = slice(edges[p], edges[p + 1])
            if edges[p] == edges[p + 1]:
                continue
            at = np.searchsorted(self.hashes[p], distinct[own])
            if not (self.hashes[p][at] == distinct[own]).all():
                raise KeyError("a word is not in the table; it was made from other texts")
            stop = self.ends[p][at]
            begin = np.where(at > 0, self.ends[p][np.maximum(at - 1, 0)], 0)
            n = lengths[own] = stop - begin
            before = np.cumsum(n) - n
            pieces.append(self.ids[p][np.repeat(begin - before, n) + np.arange(n.sum())])
        return np.concatenate(pieces), np.cumsum(lengths) - lengths, lengths
