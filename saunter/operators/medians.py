"""Exact medians per group, of groups of any size and any distribution.

Groups of up to ``SMALL`` values are one aggregate: counts by value, merged. A larger group's middle is narrowed first.
A mergeable quantile sketch of what is left gives edges at every 1 / ``SLICES`` of its rows, so how values are spread
doesn't matter; the slices around the middle ranks stay, under 1 % of the rows, and what lies below is counted. That
is repeated until the middle of each group is small; only its values are ordered, counted by value. A value that very many rows
have makes an edge of its own, and is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saunter.sources.folders import staged

#: Values of a group that one aggregate, or one window, may hold.
SMALL = 100_000
SLICES, ACCURACY = 1000, 10_000
#: Slices on either side of a middle rank that stay: twenty times the sketch's error.
ROOM = 2


def _same(a: str, b: str, keys) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys))


def _inside(rows: DataFrame, state: DataFrame, keys, *more: str) -> DataFrame:
    """The rows of the groups of ``state`` that lie in their interval (an open end is null), with further columns of the state."""
    joined = rows.alias("b").join(state.alias("s"), _same("b", "s", keys))
    kept = joined.where("b._v is not null and (s._lo is null or b._v >= s._lo) and (s._hi is null or b._v <= s._hi)")
    return kept.select("b.*", *(f"s.{c}" for c in more))


def narrowed(rows: DataFrame, keys, sizes: DataFrame) -> DataFrame:
    """Staged (keys, _n, _lo, _hi, _start, _inner): an interval per group that holds its middle values; ``_start`` values lie below,
    ``_inner`` strictly inside. It ends when all are small or no interval gets smaller."""
    none = F.lit(None).cast("double")
    state = staged(sizes.select(*keys, "_n", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_start"), F.col("_n").alias("_held"), F.col("_n").alias("_inner"), F.lit(True).alias("_go")))
    grid = F.array(*(F.lit(k / SLICES) for k in range(1, SLICES)))
    while not (todo := state.where(f"_go and _inner > {SMALL}")).isEmpty():
        sketch = _inside(rows, todo, keys).groupBy(*keys).agg(F.percentile_approx("_v", grid, F.lit(ACCURACY)).alias("_edges"))
        first, last = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
        low, high = F.floor((first - F.col("_start")) * SLICES / F.col("_held")) - ROOM, F.ceil((last - F.col("_start")) * SLICES / F.col("_held")) + ROOM
        edged = todo.alias("t").join(sketch.alias("k"), _same("t", "k", keys)).select("t.*", "_edges").withColumns({
            "_new_lo": F.when(low < 1, F.col("_lo")).otherwise(F.get("_edges", (low - 1).cast("int"))), "_new_hi": F.when(high > SLICES - 1, F.col("_hi")).otherwise(F.get("_edges", (high - 1).cast("int")))}).drop("_edges")
        edged = staged(edged)
        below, above = F.col("_v") < F.col("_new_lo"), F.col("_v") > F.col("_new_hi")
        counted = _inside(rows, edged, keys, "_new_lo", "_new_hi").groupBy(*keys).agg(
            F.count_if(below).alias("_below"), F.count_if(~F.coalesce(below, F.lit(False)) & ~F.coalesce(above, F.lit(False))).alias("_mid"),
            F.count_if(F.coalesce(F.col("_v") > F.col("_new_lo"), F.lit(True)) & F.coalesce(F.col("_v") < F.col("_new_hi"), F.lit(True))).alias("_new_inner"))
        holds = (F.col("_start") + F.col("_below") < first) & (F.col("_start") + F.col("_below") + F.col("_mid") >= last) & (F.col("_new_inner") < F.col("_inner"))
        new = edged.alias("t").join(counted.alias("k"), _same("t", "k", keys)).select("t.*", "_below", "_mid", "_new_inner").withColumn("_go", holds)
        moved = new.select(*keys, "_n", *(F.when(F.col("_go"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_new_lo", "_lo"), ("_new_hi", "_hi"))),
                           (F.col("_start") + F.when(F.col("_go"), F.col("_below")).otherwise(0)).alias("_start"),
                           *(F.when(F.col("_go"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_mid", "_held"), ("_new_inner", "_inner"))), "_go")
        state = staged(state.where(f"not (_go and _inner > {SMALL})").unionByName(moved))
    return state


def _large_medians(rows: DataFrame, keys, sizes: DataFrame, name: str) -> DataFrame:
    state = narrowed(rows, keys, sizes)
    by_value = _inside(rows, state, keys, "_n", "_start").groupBy(*keys, "_v", "_n", "_start").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
    middle = by_value.withColumn("_before", before).where("_before < _n div 2 + 1 and _before + _c >= (_n + 1) div 2")
    return middle.groupBy(*keys).agg((0.5 * F.min("_v") + 0.5 * F.max("_v")).alias(name))


def grouped_median(df: DataFrame, keys, value: Column, name: str) -> DataFrame:
    """Exact medians per group (null keys are groups too); a group without a value has a null. It counts the groups first: one job.

    No keys make one group. NaN is a value above all others here: `clean` it before if it means missing.
    """
    keys = list(keys)
    if not keys:
        return grouped_median(df.withColumn("_all", F.lit(0)), ["_all"], value, name).drop("_all")
    rows = df.select(*(F.col(f"`{k}`") for k in keys), value.cast("double").alias("_v"))
    quoted = [f"`{k}`" for k in keys]
    sizes = rows.groupBy(*quoted).agg(F.count("_v").alias("_n")).where(F.col("_n") > SMALL)
    if sizes.isEmpty():
        return rows.groupBy(*quoted).agg(F.median("_v").alias(name))
    large = staged(sizes)
    rest = rows.alias("b").join(large.alias("s"), _same("b", "s", keys), "left_anti").groupBy(*quoted).agg(F.median("_v").alias(name))
    return rest.unionByName(_large_medians(rows, keys, large, name))
