"""Running aggregates over a whole table (or a hot group) without a single-task window.

Rows are range-partitioned on (group, order) into sorted buckets. Each bucket computes its own running
value; what the earlier buckets contribute is one row per bucket and is added through a broadcast of at
most as many rows as there are shuffle partitions. Only the first group of a bucket can have begun in an
earlier bucket, so that stays true however many groups there are and however large one of them is.

Bucket membership comes from a sampled range partitioning, so it is fixed once by a reliable checkpoint;
a lost executor then re-reads the same buckets instead of sampling new ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ensure_checkpoint_dir

BUCKET = "__bucket"


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, max, min or last (last non-null value)."""

    kind: str
    value: Column
    inclusive: bool = True

    def over(self, value: Column, window) -> Column:
        functions = {"sum": F.sum, "max": F.max, "min": F.min}
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return functions[self.kind](value).over(window)

    def total(self, value: Column, order: Column) -> Column:
        if self.kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), order))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value)

    def merge(self, before: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        if self.kind == "last":
            return F.coalesce(local, before)
        return F.greatest(before, local) if self.kind == "max" else F.least(before, local)


class OrderedRows:
    """A table held in sorted buckets, to which running columns can be added lazily."""

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str],
        partition_by: Sequence[str] = (),
        buckets: int | None = None,
    ):
        ensure_checkpoint_dir(df.sparkSession)
        self.order_by, self.partition_by = list(order_by), list(partition_by)
        keys = [F.col(c) for c in (*self.partition_by, *self.order_by)]
        ranged = df.repartitionByRange(buckets, *keys) if buckets else df.repartitionByRange(*keys)
        self.df = ranged.withColumn(BUCKET, F.spark_partition_id()).checkpoint()

    def _group(self) -> Column:
        return F.struct(F.lit(0).alias("_"), *[F.col(c) for c in self.partition_by])

    def _replace(self, df: DataFrame) -> "OrderedRows":
        other = object.__new__(OrderedRows)
        other.order_by, other.partition_by, other.df = self.order_by, self.partition_by, df
        return other

    def with_columns(self, columns: dict[str, Column]) -> "OrderedRows":
        return self._replace(self.df.withColumns(columns))

    def with_running(self, **running: Running) -> "OrderedRows":
        """Add running columns; every one sees exactly the rows before it in (group, order)."""
        names = list(running)
        valued = self.df.withColumns({f"__v_{n}": running[n].value for n in names})

        order = F.struct(*[F.col(c) for c in self.order_by])
        totals = valued.groupBy(BUCKET, *self.partition_by).agg(
            *[running[n].total(F.col(f"__v_{n}"), order).alias(f"__t_{n}") for n in names]
        )
        held = F.struct(*[F.col(f"__t_{n}") for n in names])
        edges = totals.groupBy(BUCKET).agg(
            F.min(self._group()).alias("first"),
            F.max(self._group()).alias("last"),
            F.max_by(held, self._group()).alias("held"),
        )
        steps = edges.select(BUCKET, F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("first").alias("g"), F.lit(None).cast(edges.schema["held"].dataType).alias("held")),
            F.struct(F.lit(1).alias("side"), F.col("last").alias("g"), F.col("held").alias("held")),
        )).alias("s")).select(BUCKET, "s.*")
        earlier = W.partitionBy("g").orderBy(BUCKET, "side").rowsBetween(W.unboundedPreceding, -1)
        offsets = steps.select(BUCKET, "side", F.col("g").alias("__g"), *[
            running[n].over(F.col(f"held.__t_{n}"), earlier).alias(f"__o_{n}") for n in names
        ]).where("side = 0").drop("side")

        within = W.partitionBy(BUCKET, *self.partition_by).orderBy(*self.order_by)
        local = valued.withColumns({
            f"__l_{n}": running[n].over(
                F.col(f"__v_{n}"),
                within.rowsBetween(W.unboundedPreceding, 0 if running[n].inclusive else -1),
            )
            for n in names
        })
        continued = self._group().eqNullSafe(F.col("__g"))
        merged = local.join(F.broadcast(offsets), BUCKET, "left").withColumns({
            n: running[n].merge(F.when(continued, F.col(f"__o_{n}")), F.col(f"__l_{n}")) for n in names
        })
        return self._replace(merged.select(*[c for c in self.df.columns if c not in names], *names))

    def with_previous(self, **columns: str) -> "OrderedRows":
        """Add the preceding row's value of each column (NULL at the start of a group)."""
        added = self.with_running(**{
            name: Running("last", F.struct(F.col(source).alias("v")), inclusive=False)
            for name, source in columns.items()
        })
        return added.with_columns({name: F.col(f"{name}.v") for name in columns})

    def with_position(self, name: str = "pos") -> "OrderedRows":
        """Add the zero-based position of the row in its group."""
        return self.with_running(**{name: Running("sum", F.lit(1).cast("bigint"), inclusive=False)})

    def rows(self) -> DataFrame:
        return self.df.drop(BUCKET)
