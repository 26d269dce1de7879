"""Slices, aggregates and profiles of trial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saunter.functions.exprs import clean, step_law_mean
from saunter.operators.medians import grouped_median
from saunter.sources.trials import require_columns

BASE_KEYS = ["mu", "surface", "TargetShape", "n_walkers"]
#: The wide default keys of the elongation series. They include the touch steps of single trials.
WIDE_KEYS = ["n_walkers", "n_volume", "lmax", "surface", "TargetShape", "n_targets", "fixed_target_dist", "probability", "surface_selector",
             "first_touch_steps", "second_touch_steps", "delta_selector", "delta"]
LARGE_LIST = 1000


def slice_eq(df: DataFrame, fixed: dict) -> DataFrame:
    """Rows where every column equals its value; a value of None leaves its column free."""
    fixed = {name: value for name, value in fixed.items() if value is not None}
    for name, value in fixed.items():
        df = require_columns(df, fixed).where(F.col(name) == F.lit(value))
    return df


def slice_in(df: DataFrame, name: str, values) -> DataFrame:
    """Membership; None leaves the column free. Long lists become a semi join."""
    if values is None:
        return df
    values = list(values)
    if len(values) <= LARGE_LIST:
        return df.where(F.col(name).isin(values))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"`{name}` {df.schema[name].dataType.simpleString()}")
    return df.join(listed, name, "left_semi")


def large_surfaces(df: DataFrame, surfaces=None, least: float = 100.0) -> DataFrame:
    """The listed surfaces, or all above ``least``."""
    return slice_in(df, "surface", surfaces) if surfaces is not None else df.where(F.col("surface") > least)


def checked(df: DataFrame, strict: bool = False) -> DataFrame:
    """An empty result passes with its schema, unless ``strict``: then it is an error (one small job)."""
    if strict and df.isEmpty():
        raise ValueError("no rows match")
    return df


def group_keys(fixed: dict, base=None) -> list[str]:
    """The base keys and each key that was fixed."""
    base = BASE_KEYS if base is None else base
    return [*base, *(k for k, v in fixed.items() if v is not None and k not in base)]


def with_elongation(df: DataFrame) -> DataFrame:
    """x2 = sqrt(surface), x1 = x2^delta, and x_ratio, which is x1."""
    x2 = F.sqrt(F.col("surface").cast("double"))
    df = df.withColumn("x2", x2).withColumn("x1", F.pow("x2", F.col("delta").cast("double")))
    return df.withColumn("x_ratio", F.col("x1"))


def _kept(df: DataFrame, keys, drop_null_keys: bool) -> DataFrame:
    require_columns(df, keys)
    return df.dropna(subset=list(keys)) if drop_null_keys else df


#: How a named aggregate is made; exact medians are `grouped_median`.
AGGREGATES = {
    "mean": lambda c: F.avg(c),
    "approx_median": lambda c: F.percentile_approx(c, 0.5, 10_000),
}


def cond_agg(df: DataFrame, keys, agg: str = "mean", value: str = "detection_time", name: str | None = None, drop_null_keys: bool = True) -> DataFrame:
    """One row per group with the named aggregate of ``value``; NaN counts as missing."""
    if agg not in (*AGGREGATES, "median"):
        raise ValueError(f"no aggregate {agg!r}; known: {sorted([*AGGREGATES, 'median'])}")
    v = clean(F.col(value).cast("double"))
    if agg == "median":
        return grouped_median(_kept(df, keys, drop_null_keys), keys, v, name or value)
    return _kept(df, keys, drop_null_keys).groupBy(*keys).agg(AGGREGATES[agg](v).alias(name or value))


def cond_mean(df: DataFrame, keys, value: str = "detection_time", **kw) -> DataFrame:
    return cond_agg(df, keys, "mean", value, **kw)


def cond_median(df: DataFrame, keys, value: str = "detection_time", approx: bool = False, **kw) -> DataFrame:
    return cond_agg(df, keys, "approx_median" if approx else "median", value, **kw)


def cond_summary(df: DataFrame, keys, value: str = "detection_time", drop_null_keys: bool = True) -> DataFrame:
    """n, mean, sample deviation (0 for one value) and standard error per group."""
    v = clean(F.col(value).cast("double"))
    out = _kept(df, keys, drop_null_keys).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    out = out.withColumn("std", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("std")))
    return out.withColumn("sem", F.try_divide(F.col("std"), F.sqrt(F.col("n").cast("double"))))


def axis_range(df: DataFrame, value: str, pad: float = 0.05) -> DataFrame:
    """One row: the smallest and largest value, each moved out by a share of the span."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = (F.col("hi") - F.col("lo")) * pad
    return ends.select((F.col("lo") - span).alias("axis_min"), (F.col("hi") + span).alias("axis_max"))


def moment_check(df: DataFrame, mu: Column | str = "mu", step: str = "l", lmax: str = "lmax") -> DataFrame:
    """Per mu and lmax: the mean step length against the closed form."""
    out = df.groupBy(F.col(mu).alias("mu") if isinstance(mu, str) else mu, lmax).agg(F.count("*").alias("n"), F.avg(step).alias("mean"))
    out = out.withColumn("expected", step_law_mean("mu", lmax)).withColumn("abs_error", F.abs(F.col("mean") - F.col("expected")))
    return out.withColumn("rel_error", F.try_divide("abs_error", F.col("expected")))


def levels(df: DataFrame, name: str, where: dict | None = None) -> DataFrame:
    """The distinct values of a column, sorted; of one category if ``where`` fixes it."""
    return slice_eq(df, where or {}).select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)


def key_profile(df: DataFrame, keys) -> DataFrame:
    """One row per (key, level), with its rows: all keys in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("level")) for k in keys)))
    return df.select(pairs.alias("p")).where("p.level is not null").groupBy(F.col("p.key").alias("key"), F.col("p.level").alias("level")).agg(F.count("*").alias("n"))
