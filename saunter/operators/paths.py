"""Recorded trajectories: path length, wrapped positions, touches and first passage.

Steps are rows (trial_id, walker_id, step, l, theta, phi, x0, y0, z0, u). Running sums are made in
chunks of a walker's steps (`running_sums`), so no task holds a whole trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saunter.functions.exprs import direction, torus_dist2, wrap

WALKER = ["walker_id"]


#: Steps of a walker that one window holds.
CHUNK = 100_000


def running_sums(df: DataFrame, part, order, sums: dict[str, Column], chunk: int = CHUNK, of: Column | None = None) -> DataFrame:
    """Adds a running sum within ``part`` for each of ``sums``, dealt out by chunks of the first order column (a whole number).

    A chunk's offset is the sum of the chunks before it: a window over one row per chunk. All sums share
    the shuffles. ``of`` gives chunks otherwise: any expression that never falls along the order.
    """
    part, order = list(part), [order] if isinstance(order, str) else list(order)
    cut = df.withColumns({"_chunk": F.floor(F.col(order[0]) / chunk).cast("long") if of is None else of.cast("long")} | {f"_s_{k}": v for k, v in sums.items()})
    totals = cut.groupBy(*part, "_chunk").agg(*(F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(totals.dtypes)
    offsets = totals.select(*(F.col(c).alias(f"_p_{c}") for c in (*part, "_chunk")), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0).cast(kinds[f"_t_{k}"])).alias(f"_b_{k}") for k in sums))
    within = Window.partitionBy(*part, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumns({f"_w_{k}": F.sum(f"_s_{k}").over(within) for k in sums})
    out = inner.join(offsets, [inner[c].eqNullSafe(offsets[f"_p_{c}"]) for c in (*part, "_chunk")])
    return out.select(*(c for c in df.columns if c not in sums), *((F.col(f"_b_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums))


def ordinals(df: DataFrame, part, order, name: str, chunk: int = CHUNK, of: Column | None = None) -> DataFrame:
    """Adds 1, 2, ... within ``part`` in ``order``: a running count in chunks, so no task holds all rows of one key."""
    return running_sums(df, part, order, {name: F.lit(1).cast("long")}, chunk, of).withColumn(name, F.col(name).cast("int"))


def path_length(steps: DataFrame, part=WALKER, chunk: int = CHUNK) -> DataFrame:
    """Adds ``time``: the path length up to and with each step."""
    return running_sums(steps, part, "step", {"time": F.col("l")}, chunk)


def wrapped_position(steps: DataFrame, side: float, part=WALKER, chunk: int = CHUNK) -> DataFrame:
    """Adds time and x, y, z after each step. Sums are wrapped once, so they may differ from stepwise wrapping by rounding."""
    moved = dict(zip("xyz", (F.col("l") * d for d in direction("theta", "phi"))))
    out = running_sums(steps, part, "step", {"time": F.col("l"), **moved}, chunk)
    return out.withColumns({a: wrap(F.col(f"{a}0") + F.col(a), side) for a in "xyz"})


def hits_of_ball(positions: DataFrame, centre, radius: float, side: float) -> DataFrame:
    """The steps that end within ``radius`` of a point."""
    return positions.where(torus_dist2(("x", "y", "z"), [F.lit(float(c)) for c in centre], side) <= radius * radius)


def touches(hits: DataFrame, part=WALKER, order=("step",), chunk: int = CHUNK) -> DataFrame:
    """Adds touch_no to hit rows: 1, 2, ... per walker in order, in chunks of steps. With several targets a step, order by (step, target_no)."""
    return ordinals(hits, part, order, "touch_no", chunk)


def touch_steps(walkers: DataFrame, hits: DataFrame, part=WALKER, order=("step",)) -> DataFrame:
    """Per walker the step numbers of the first and second touch, -1 where there is none."""
    nth = lambda k: F.min(F.when(F.col("touch_no") == k, F.col("step")))
    found = touches(hits, part, order).where("touch_no <= 2").groupBy(*part).agg(nth(1).alias("first_touch_steps"), nth(2).alias("second_touch_steps"))
    out = walkers.select(*part).distinct().join(found, list(part), "left")
    return out.select(*part, *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_touch_steps", "second_touch_steps")))


def first_passage(hits: DataFrame, max_touches: int, p: float, part=WALKER, order=("step",), carry=("time",), chunk: int = CHUNK) -> DataFrame:
    """Per walker the touch that ends its search: number ``max(1, max_touches)``, or an earlier one whose draw u is at most p.

    With ``max_touches`` of 1 or less the first touch ends it, whatever p is. Walkers without
    such a touch have no row. The first such touch is an aggregate that merges, so a long walker is spread over tasks.
    """
    final = touches(hits, part, order, chunk).where((F.col("touch_no") >= max(1, max_touches)) | (F.col("u") <= p))
    row = F.min_by(F.struct("step", "touch_no", *carry), F.struct(*order))
    return final.groupBy(*part).agg(row.alias("r")).select(*part, "r.*")


def earliest_walker(passages: DataFrame, trial: str = "trial_id", time: str = "time") -> DataFrame:
    """Per trial the walker that finds the target first (the smaller walker_id on ties)."""
    best = F.struct(F.col(time), F.col("walker_id"))
    cols = [c for c in passages.columns if c != trial]
    return passages.groupBy(trial).agg(F.min_by(F.struct(*cols), best).alias("r")).select(trial, "r.*")


def trial_complete(walkers: DataFrame, passages: DataFrame, trial: str = "trial_id") -> DataFrame:
    """Per trial whether its result is final: every walker has found the target or walked past the best time.

    ``walkers``: (trial, walker_id, time) with each walker's whole recorded path length.
    """
    best = passages.groupBy(trial).agg(F.min("time").alias("best_time"))
    found = passages.select(trial, "walker_id").distinct().withColumn("found", F.lit(True))
    all_in = walkers.join(found, [trial, "walker_id"], "left").join(best, trial, "left")
    done = F.coalesce(F.col("found"), F.lit(False)) | F.coalesce(F.col("time") >= F.col("best_time"), F.lit(False))
    return all_in.groupBy(trial).agg(F.count("*").alias("walkers"), F.first("best_time").alias("best_time"), F.bool_and(done).alias("complete"))


def prefix_sum(df: DataFrame, part, order: str, value: str, chunk: int = CHUNK, name: str = "running") -> DataFrame:
    """`running_sums` of one column."""
    return running_sums(df, part, order, {name: F.col(value)}, chunk)
