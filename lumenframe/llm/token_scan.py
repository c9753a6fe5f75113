"""Token counts by scanning flat token files for the end-of-document id.

A flat file holds nothing but fixed-width ids, one document after the other, each closed by the end id; there is no
index. Files are cut into blocks of equal size. Each block is searched with one vectorised comparison and gives the
lengths of the documents that end in it; its first document may have begun in an earlier block. What a block carries
into the next is combined by a prefix scan over the blocks' summaries (ends, tokens after the last end), so a document
may span any number of blocks.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import keep, mounted, shared_path, text_slices

BLOCK_TOKENS = 1 << 20
DTYPE = "<u2"


def write_flat(docs: DataFrame, encoder: Callable, end_id: int, folder: str, dtype: str = DTYPE) -> DataFrame:
    """Write every document's ids and ``end_id`` into flat files, one per task, and give (file, doc_id, ordinal).

    ``encoder()`` gives, in a task, the object whose ``encode`` turns texts into their ids' bytes.
    ``folder`` is in the shared folder, mounted on all workers. A repeated task writes a file under a new name; only
    the names that this table holds count. Null texts are empty. Ids must fit ``dtype``, and no text may hold the
    end id itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = mounted(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, name, ordinal = encoder(), f"{uuid.uuid4().hex}.tokens", 0
        os.makedirs(place, exist_ok=True)
        with open(f"{place}/{name}.part", "wb") as out:
            for batch in batches:
                for rows, texts in text_slices(batch):
                    for coded in coder.encode(texts):
                        ids = np.frombuffer(coded, "<u4")
                        if len(ids) and (int(ids.max()) > np.iinfo(dtype).max or (ids == end_id).any()):
                            raise ValueError("an id does not fit the file, or is the end id")
                        out.write(np.append(ids, np.uint32(end_id)).astype(dtype).tobytes())
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n, pa.string()), rows.column("doc_id"),
                         pa.array(np.arange(ordinal, ordinal + n))], ["file", "doc_id", "ordinal"])
                    ordinal += n
        os.replace(f"{place}/{name}.part", f"{place}/{name}")

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, doc_id {kind}, ordinal long")


def _scan_rows(place: str, end_id: int, dtype: str):
    """Per block: how many documents end in it, their lengths as far as the block shows them, and what is left over."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(f"{place}/{row['file']}", "rb") as source:
                    source.seek(row["at"] * width)
                    ids = np.frombuffer(source.read(row["size"] * width), dtype)
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends, prepend=-1)
                left = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["at"]], pa.int64()), pa.array([len(ends)], pa.int64()),
                     pa.array([left], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))],
                    ["file", "at", "ends", "left", "lengths"])
    return run


def scan_flat(spark: SparkSession, folder: str, files: DataFrame, end_id: int, dtype: str = DTYPE,
              block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in flat files (``files``: file), its end id included.

    Tokens after a file's last end id form one more document, which never had an end. Empty files have none.
    """
    place, width = mounted(folder), np.dtype(dtype).itemsize

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            sizes = [os.path.getsize(f"{place}/{n}") // width for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], ["file", "tokens"])

    sizes = files.select("file").distinct().mapInArrow(measure, "file string, tokens long")
    blocks = sizes.where("tokens > 0").select("file", "tokens", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))).alias("at")).select(
        "file", "at", F.least(F.lit(block), F.col("tokens") - F.col("at")).alias("size"))
    found = keep(blocks.repartition(max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(
        _scan_rows(place, end_id, dtype), "file string, at long, ends long, left long, lengths array<bigint>"), "blocks")

    # Prefix scan over the summaries: a row per block, in the order of the file.
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    running = found.select("file", "at", "ends", "left").withColumn(
        "first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn(
        "total_left", F.coalesce(F.sum("left").over(before), F.lit(0))).withColumn(
        "since", F.when(F.col("ends") > 0, F.sum("left").over(before))).withColumn(
        "reset", F.coalesce(F.last(F.when(F.col("ends") > 0, F.coalesce("since", F.lit(0))), True).over(before), F.lit(0)))
    # Tokens carried in: those left over since the last block that had an end, that block's own rest included.
    carried = running.select("file", "at", "first", (F.col("total_left") - F.col("reset")).alias("carry"))
    stitched = found.join(carried, ["file", "at"])
    ended = stitched.where("ends > 0").select("file", "at", "first", "carry", F.posexplode("lengths").alias("i", "n"))
    documents = ended.select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"),
        (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
    tail = found.groupBy("file").agg(F.max_by(F.struct("at", "left", "ends"), "at").alias("last")).join(
        carried, "file").where("at = last.at").select(
        "file", (F.col("first") + F.col("last.ends")).alias("ordinal"),
        (F.col("last.left") + F.when(F.col("last.ends") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")).where("n_tokens > 0")
    return documents.unionByName(tail)


def token_counts(docs: DataFrame, encoder: Callable, end_id: int) -> DataFrame:
    """(doc_id, n_tokens) of every document, its end id included, through flat files and the separator scan.

    Repeated rows are documents of their own, as are rows without doc_id; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    written = keep(write_flat(docs, encoder, end_id, folder), "token-files")
    counted = scan_flat(spark, folder, written, end_id)
    return written.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
