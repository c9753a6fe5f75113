"""Exact quantiles (linear interpolation) that never gather, sort or deal out a column or a group.

``exact_quantiles`` narrows a bracket of values around every wanted rank, in rounds. Each round is one aggregate: of
each bracket the rows below it, at its ends and inside it are counted, and the inside is sketched (KLL, merged on the
map side). The counts tell exactly where the rank lies; the sketch gives the next, over 100 times narrower bracket, and
what is small by then is gathered. A sketch that erred costs a round, never a wrong number. ``weighted_quantiles`` ranks values that come with counts by running counts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import ensure_checkpoint_dir, share_package
from .ordered import OrderedRows, Running

SKETCH_SIZE = 4096  # parameter of the KLL sketches; ranks are off by about 0.1 % of the rows
GRID = 1024  # quantiles read from a sketch; that many values or fewer are all among them
MARGIN = 3  # steps of the grid by which a bracket is wider than the rank on either side
GATHERED = 1 << 16  # values that a bracket may be expected to hold when it is gathered instead of sketched
DRIVER_ROWS = 2000  # (group, column) pairs whose brackets the driver narrows and broadcasts; more stay distributed
SALTS = 16


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def long_values(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, cid INT, value DOUBLE), cid being the column's place in ``columns``.

    One narrow aggregate over this beats one very wide aggregate, whose generated code grows past what the
    JVM compiles; a number is cheaper to hash and sort by than a name.
    """
    entries = F.array(*[
        F.struct(F.lit(i).alias("cid"), _name(c).cast("double").alias("value")) for i, c in enumerate(columns)
    ])
    return df.select(*[_name(g) for g in group], F.inline(entries))


def named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Put the column's name in place of its number."""
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("cid")).alias("column")
    return df.select(*[name if c == "cid" else F.col(f"`{c}`") for c in df.columns])


def value_counts_long(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, cid, value, cnt) of the non-null values; counted before the shuffle."""
    long = long_values(df, columns, group).where("value is not null")
    return long.groupBy(*group, "cid", "value").agg(F.count("*").alias("cnt"))


def with_running_count(
    counts: DataFrame, group: Sequence[str], order: Sequence[str], count: str, total: str | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Add ``before``: how many rows of the group come ahead of each entry; and, if named, the group's ``total``.

    ``few_groups`` says that groups are columns of a table, so that their totals can be broadcast.
    """
    ordered = OrderedRows(counts, order, group)
    ranked = ordered.with_running(before=Running("sum", F.col(count), inclusive=False)).rows()
    if not total:
        return ranked
    # The ordered entries are already materialised, so the totals cost no second pass over the input.
    totals = ordered.rows().groupBy(*group).agg(F.sum(count).alias(total))
    return ranked.join(F.broadcast(totals) if few_groups else totals, list(group))


def weighted_quantiles(
    counts: DataFrame,
    probs: Sequence[float],
    group: Sequence[str] = (),
    value: str = "value",
    count: str = "cnt",
    order: Sequence[str] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Exact quantiles per group from (group, value, count) entries -> (group, n, p, quantile).

    An entry with a NULL value stands for a stretch of rows that holds no wanted rank.
    """
    keys = list(group) or ["__all"]
    keyed = counts if group else counts.withColumn("__all", F.lit(0))
    held = with_running_count(keyed, keys, order or [value], count, total="n", few_groups=few_groups or not group)
    until = F.col("before") + F.col(count)
    picks, entries, wanted = [], [], F.lit(False)
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in ((f"__lo{i}", F.floor(position)), (f"__hi{i}", F.ceil(position))):
            here = (F.col("before") <= rank) & (rank < until)
            wanted = wanted | here
            picks.append(F.max(F.when(here, F.col(value))).alias(side))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        entries.append(F.struct(
            F.lit(float(p)).alias("p"), (low + (high - low) * (position - F.floor(position))).alias("quantile")
        ))
    # Only the few entries that hold a wanted rank go on to the grouping.
    result = held.where(wanted).groupBy(*keys, "n").agg(*picks).select(*keys, "n", F.inline(F.array(*entries)))
    return result if group else result.drop("__all")


_STATE = "a double, b double, x double, y double, low double, high double, gather boolean"


def quantile_grid(sketch: Column) -> Column:
    """``GRID`` quantiles of a sketch, values that were met; NULL if it is empty."""
    ranks = F.expr(f"array({', '.join(f'{(j + 0.5) / GRID!r}D' for j in range(GRID))})")
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def _narrowed(p: float, n: int, old: dict, seen: dict) -> dict:
    """The state of one wanted quantile after a round.

    ``old`` has a bracket's ends x and y, what surrounds it (a, b) and the values found so far for the two ranks (low,
    high); ``seen`` counts rows below x, up to x, below y and up to y, and has quantiles of what lies inside (grid) or,
    where it was gathered, its values with their counts (held).
    """
    if old["x"] is None:
        return old
    below, to_x, until_y, to_y = (seen[k] for k in ("below", "to_x", "until_y", "to_y"))
    size, steps = until_y - to_x, len(seen["grid"] or ())

    def found(rank: int, known: float | None) -> float | None:
        if known is not None:
            return known
        if below <= rank < to_x:
            return old["x"]
        if until_y <= rank < to_y:
            return old["y"]
        if to_x <= rank < until_y:
            if seen["held"]:
                until = to_x
                for held in seen["held"]:
                    until += held["cnt"]
                    if rank < until:
                        return held["value"]
            if size <= steps:
                return seen["grid"][int((rank - to_x + 0.5) / size * steps)]
        return None

    ranks = math.floor((n - 1) * p), math.ceil((n - 1) * p)
    new = dict(old, low=found(ranks[0], old["low"]), high=found(ranks[1], old["high"]), gather=False)
    still = [r for r, q in zip(ranks, ("low", "high"), strict=True) if new[q] is None]
    if not still:
        return dict(new, a=None, b=None, x=None, y=None)
    # The two ranks are neighbours, and a bracket's end is a value of the data: what is open lies in one region.
    if still[0] < below:
        return dict(new, b=old["x"], x=old["a"], y=old["x"])
    if still[0] >= to_y:
        return dict(new, a=old["y"], x=old["y"], y=old["b"])
    first = int((still[0] - to_x) / size * steps) - MARGIN
    last = math.ceil((still[-1] - to_x + 1) / size * steps) + MARGIN
    return dict(new, a=old["x"], b=old["y"], x=seen["grid"][first] if first >= 0 else old["x"],
                y=seen["grid"][last] if last < steps else old["y"], gather=size * 2.0 * (MARGIN + 2) / steps <= GATHERED)


def _advance(counts: DataFrame, probs: Sequence[float], names: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """The next state of all groups and columns, a row of counts each; and whether it is small enough to broadcast."""
    schema = StructType([*(counts.schema[k] for k in (*keys, "n")), *(StructField(q, StructType.fromDDL(_STATE)) for q in names)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, states = batch.column("n").to_pylist(), []
            for q, p in zip(names, probs, strict=True):
                rows = zip(sizes, batch.column(q).to_pylist(), batch.column(f"{q}_seen").to_pylist(), strict=True)
                states.append(pa.array([_narrowed(p, n, old, new) for n, old, new in rows], arrow.field(q).type))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "n")), *states], schema=arrow)

    few = counts.limit(DRIVER_ROWS + 1).toArrow()
    if not few.num_rows:
        return counts.sparkSession.createDataFrame([], schema), True
    if few.num_rows <= DRIVER_ROWS:
        moved = pa.Table.from_batches(run(few.cast(to_arrow_schema(counts.schema)).to_batches()), arrow)
        return counts.sparkSession.createDataFrame(moved, schema), True
    ensure_checkpoint_dir(counts.sparkSession)
    return counts.mapInArrow(run, schema).checkpoint(), False


def _met(long: DataFrame, waiting: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Values beside the brackets of their group and column; a hot group is spread by salted keys."""
    if small:
        return long.join(F.broadcast(waiting), list(keys))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return long.withColumn("__salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(
        waiting.withColumn("__salt", salts), [*keys, "__salt"]).drop("__salt")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles of columns, whole or within groups of any size -> (group, column, n, p, quantile).

    Columns without values give no row; NaN counts as missing; rows with a NULL group are left out. Groups of up to
    ``GRID`` values take one pass over the input, of up to 6 millions two, of up to 600 millions three.
    """
    share_package(df.sparkSession)
    keys = [*group, "cid"]
    long = long_values(df, columns, group).where(F.col("value").isNotNull() & ~F.isnan("value"))
    for g in group:
        long = long.where(_name(g).isNotNull())
    names, by = [f"__q{i}" for i in range(len(probs))], [_name(k) for k in keys]
    value, none = F.col("value"), F.lit(None).cast("double")
    low, high = F.lit(-math.inf), F.lit(math.inf)
    whole = F.struct(low.alias("a"), high.alias("b"), low.alias("x"), high.alias("y"), none.alias("low"), none.alias("high"),
                     F.lit(False).alias("gather"))

    def seen(below: Column, to_x: Column, until_y: Column, to_y: Column, grid: Column, held: Column) -> Column:
        return F.struct(*(c.cast("long").alias(k) for k, c in (("below", below), ("to_x", to_x), ("until_y", until_y), ("to_y", to_y))),
                        grid.alias("grid"), held.alias("held"))

    n, nothing, empty = F.col("n"), F.lit(0), F.lit(None).cast("array<struct<value:double,cnt:bigint>>")
    present = df
    for g in group:
        present = present.where(_name(g).isNotNull())
    # The first round takes all rows; a column's sketch is an aggregate of its own, which spares a row per value.
    numbers = [F.nanvl(_name(c).cast("double"), none) for c in columns]
    sketched = present.groupBy(*map(_name, group)).agg(*(x for i, v in enumerate(numbers) for x in (
        F.count(v).alias(f"__n{i}"), F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE)).alias(f"__s{i}"))))
    counts = sketched.select(*map(_name, group), F.inline(F.array(*(F.struct(
        F.lit(i).alias("cid"), F.col(f"__n{i}").alias("n"), F.col(f"__s{i}").alias("sketch")) for i in range(len(columns)))))
    ).where("n > 0").withColumn("grid", quantile_grid(F.col("sketch"))).select(*by, "n", *(x for q in names for x in (
        whole.alias(q), seen(nothing, nothing, n, n, F.col("grid"), empty).alias(f"{q}_seen"))))
    done = []
    unfinished = F.coalesce(*(F.col(f"{q}.x") for q in names)).isNotNull()
    while True:
        state, small = _advance(counts, probs, names, keys)
        done.append(state.where(~unfinished))
        waiting = state.where(unfinished)
        if waiting.isEmpty():
            break
        met = _met(long, waiting, keys, small)
        # Rows become counts by their place (below x, x, inside, y, above) first; only gathered values are told apart.
        places = {q: F.when(value < F.col(f"{q}.x"), 0).when(value == F.col(f"{q}.x"), 1).when(
            value < F.col(f"{q}.y"), 2).when(value == F.col(f"{q}.y"), 3).otherwise(4) for q in names}
        kept = functools.reduce(Column.__or__, ((places[q] == 2) & F.col(f"{q}.gather") for q in names))
        cells = met.groupBy(*by, *(c.alias(f"{q}_at") for q, c in places.items()), F.when(kept, value).alias("value")).agg(
            F.count("*").alias("cnt"))

        def rows(q: str, *at: int) -> Column:
            return F.coalesce(F.sum(F.when(F.col(f"{q}_at").isin(*at), F.col("cnt"))), F.lit(0))

        counts = cells.groupBy(*by).agg(*(x for q in names for x in (
            rows(q, 0).alias(f"{q}_below"), rows(q, 0, 1).alias(f"{q}_to_x"), rows(q, 0, 1, 2).alias(f"{q}_until_y"),
            rows(q, 0, 1, 2, 3).alias(f"{q}_to_y"),
            F.sort_array(F.collect_list(F.when((F.col(f"{q}_at") == 2) & value.isNotNull(), F.struct("value", "cnt"))))
            .alias(f"{q}_held"))))
        # Where a bracket is still too wide to be gathered, a second aggregate sketches its inside.
        wide = [q for q in names if not waiting.where(F.col(f"{q}.x").isNotNull() & ~F.col(f"{q}.gather")).isEmpty()]
        grids = waiting.select(*by, "n", *names)
        if wide:
            inner = {q: F.when((places[q] == 2) & ~F.col(f"{q}.gather"), value) for q in wide}
            sketches = met.where(F.coalesce(*inner.values()).isNotNull()).groupBy(*by).agg(*(
                quantile_grid(F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE))).alias(f"{q}_grid") for q, v in inner.items()))
            grids = grids.join(F.broadcast(sketches) if small else sketches, keys, "left")
        no_grid = F.lit(None).cast("array<double>")
        # A row per group and column on both sides.
        counts = grids.join(F.broadcast(counts) if small else counts, keys).select(*by, "n", *(x for q in names for x in (q, seen(
            *(F.col(f"{q}_{c}") for c in ("below", "to_x", "until_y", "to_y")),
            F.col(f"{q}_grid") if q in wide else no_grid, F.col(f"{q}_held")).alias(f"{q}_seen"))))
    result = functools.reduce(DataFrame.unionByName, done)
    position = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    entries = [F.struct(F.lit(float(p)).alias("p"), (
        F.col(f"{q}.low") + (F.col(f"{q}.high") - F.col(f"{q}.low")) * (at - F.floor(at))).alias("quantile"))
        for p, q, at in zip(probs, names, position, strict=True)]
    return named(result.select(*by, "n", F.inline(F.array(*entries))), columns)
