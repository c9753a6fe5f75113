"""Records that span lines, cut from files of any size by many tasks at once.

A file is read in blocks (its input splits) as pieces that end at a separator. Whether a place lies inside quotes, and
how deep in brackets, depends on all that comes before it. So every block is first summarised for either beginning,
inside or outside quotes; a prefix scan over one row per block gives the true beginnings; then each block cuts its
records alone. What a block's edges leave over, at most two fragments a block, is joined up in the order of the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import share_package

#: (inside quotes, depth) -> the same behind a piece, and whether a record ends with the piece.
Step = Callable[[bool, int, str], tuple[bool, int, bool]]
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BRACKETS = re.compile(r"[\[\]{}]")


def csv_step(inside: bool, depth: int, piece: str) -> tuple[bool, int, bool]:
    """A CSV record ends with a line that ends outside quotes; a doubled quote leaves the parity as it is."""
    inside ^= piece.count('"') % 2 == 1
    return inside, depth, not inside


def json_step(inside: bool, depth: int, piece: str) -> tuple[bool, int, bool]:
    """A record of a JSON array ends with the bracket that leads back to the array itself."""
    parts = _ESCAPED.sub("", piece).split('"')
    for part in parts[1 if inside else 0::2]:
        for bracket in _BRACKETS.findall(part):
            depth += 1 if bracket in "[{" else -1
    inside ^= len(parts) % 2 == 0
    return inside, depth, not inside and depth == 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        yield from zip(zip(files, blocks, strict=True), values, strict=True)


def _summaries(step: Step, separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple[str, int], ends: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "ends": [{"inside": i, "depth": d} for i, d in ends]}],
                                              schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(
                                                  pa.struct([("inside", pa.bool_()), ("depth", pa.int64())])))]))

        current, ends = None, []
        for key, piece in _runs(batches):
            if key != current:
                if current:
                    yield row(current, ends)
                current, ends = key, [(False, 0), (True, 0)]
            ends = [step(i, d, piece + separator)[:2] for i, d in ends]
        if current:
            yield row(current, ends)
    return run


def _cuts(step: Step, separator: str, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, held, number = [], None, [], 0
        inside, depth = False, 0

        def close(part: int, closes: bool) -> None:
            out.append((*current, number, part, closes, "".join(held)))
            held.clear()

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                columns = zip(*out, strict=True)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                                 ["file", "block", "number", "part", "closes", "record"])
                out.clear()

        for key, piece in _runs(batches):
            if key != current:
                if current and held:
                    close(2 if number else 0, False)
                current, number = key, 0
                inside, depth = starts.value[key]
            held.append(piece + separator)
            inside, depth, ended = step(inside, depth, held[-1])
            if ended:
                close(1 if number else 0, True)  # the first record of a block may have begun in an earlier one
                number += 1
            yield from flush(5000)
        if current and held:
            close(2 if number else 0, False)
        yield from flush(0)
    return run


def cut_records(spark: SparkSession, path: str, step: Step, separator: str) -> DataFrame:
    """(file, block, number, record): the records of text files, in the order (block, number) within each file.

    ``separator`` must end every record (the last one of a file may lack it) and no escape may stand before it. The
    driver holds one row per block of ``spark.sql.files.maxPartitionBytes``. A text behind the last record is given as
    one more record, unless it is blank.
    """
    share_package(spark)
    pieces = spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ends = pieces.mapInArrow(_summaries(step, separator), "file string, block long, ends array<struct<inside:boolean,depth:long>>")
    starts, file, state = {}, None, (False, 0)
    for r in sorted(ends.collect()):
        if r.file != file:
            file, state = r.file, (False, 0)
        starts[r.file, r.block] = state
        end = r.ends[state[0]]
        state = end.inside, state[1] + end.depth
    cut = pieces.mapInArrow(_cuts(step, separator, spark.sparkContext.broadcast(starts)),
                            "file string, block long, number long, part int, closes boolean, record string")
    whole = cut.where("part = 1").select("file", "block", "number", "record")
    # Fragments: at most two rows a block. A record runs up to and with the fragment that closes it.
    order = W.partitionBy("file").orderBy("block", "number")
    before = F.coalesce(F.sum(F.col("closes").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = cut.where("part <> 1").withColumn("which", before).groupBy("file", "which").agg(
        F.sort_array(F.collect_list(F.struct("block", "number", "record"))).alias("f")).select(
            "file", F.get("f", F.lit(0))["block"].alias("block"), F.get("f", F.lit(0))["number"].alias("number"),
            F.array_join("f.record", "").alias("record"))
    return whole.unionByName(joined).where(F.trim(F.regexp_replace("record", r"[\s\]}]+$", "")) != "")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files without their line ends; quotes only enclose values, or are doubled inside them."""
    return cut_records(spark, path, csv_step, "\n").withColumn("record", F.regexp_replace("record", r"\r?\n$", ""))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON arrays, each file holding one."""
    cut = cut_records(spark, path, json_step, "}")
    return cut.withColumn("record", F.regexp_replace("record", r"^[\s﻿]*[\[,]?\s*", "")).where(F.startswith("record", F.lit("{")))
