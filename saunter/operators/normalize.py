"""Ratios: to a baseline level, to the nearest level, between categories, with errors.

Baselines are aggregated: one row per key, far fewer than the trials. Whether they are
broadcast is left to Spark, which knows their size when it runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.operators.medians import grouped_median
from saunter.sources.trials import require_columns


def ratio_to_baseline(stats: DataFrame, on, level: str = "mu", base: float = 2.0, value: str = "detection_time", name: str = "ratio") -> DataFrame:
    """``value`` over its value at the base level of the same keys. Keys without a base level go."""
    require_columns(stats, [*on, level, value])
    at_base = stats.where(F.col(level) == base).select(*on, F.col(value).alias("_base"))
    return stats.join(at_base, list(on)).withColumn(name, F.try_divide(value, F.col("_base"))).drop("_base")


def ratio_below_baseline(stats: DataFrame, on, requested, level: str = "mu", base: float = 2.0, value: str = "detection_time", name: str = "ratio") -> DataFrame:
    """As `ratio_to_baseline`, of the requested levels below the base alone; the base must be requested."""
    if base not in list(requested):
        raise ValueError(f"the baseline {base} is not among the requested levels {sorted(requested)}")
    asked = stats.where(F.col(level).isin(list(requested)))
    return ratio_to_baseline(asked, on, level, base, value, name).where(F.col(level) < base)


def nearest_baseline(stats: DataFrame, on, level: str = "mu", target: float = 2.0, value: str = "mean") -> DataFrame:
    """Per key the value at the level nearest to the target, the smaller level on ties: base_level, base_value."""
    near = F.struct(F.abs(F.col(level) - target), F.col(level))
    return stats.groupBy(*on).agg(F.min_by(level, near).alias("base_level"), F.min_by(value, near).alias("base_value"))


def ratio_with_error(summary: DataFrame, on, level: str = "mu", target: float = 2.0, on_bad: str = "zero") -> DataFrame:
    """Ratio of means to the nearest base level, with propagated standard error.

    on_bad "zero": an error that is not finite is 0; "skip": rows whose base is missing or 0 go.
    """
    if on_bad not in ("zero", "skip"):
        raise ValueError("on_bad is 'zero' or 'skip'")
    near = F.struct(F.abs(F.col(level) - target), F.col(level))
    base = summary.groupBy(*on).agg(F.min_by("mean", near).alias("_mean"), F.min_by("sem", near).alias("_sem"))
    out = summary.join(base, list(on), "left").withColumn("ratio", F.try_divide("mean", F.col("_mean")))
    square = lambda a, b: F.pow(F.try_divide(F.col(a), F.col(b)), F.lit(2.0))
    out = out.withColumn("ratio_err", F.col("ratio") * F.sqrt(square("sem", "mean") + square("_sem", "_mean")))
    if on_bad == "zero":
        out = out.withColumn("ratio_err", F.coalesce("ratio_err", F.lit(0.0)))
    else:
        out = out.where(F.col("_mean").isNotNull() & (F.col("_mean") != 0))
    return out.drop("_mean", "_sem")


def ratio_between(stats: DataFrame, a, b, on, key: str, category: str = "TargetShape", value: str = "detection_time", shift: float = 2.0, carry=()) -> DataFrame:
    """Value of category ``a`` over that of ``b`` at equal keys: (on, key, a_<value>, b_<value>, ratio, carried columns of both).

    The key comes back moved by ``shift``: sizes are measured without the rim on either side.
    A category that has a key several times is matched with every row of the other.
    """
    side = lambda c, p: stats.where(F.col(category) == c).select(*on, (F.col(key) + shift).alias(key), *(F.col(v).alias(f"{p}_{v}") for v in (value, *carry)))
    both = side(a, "a").join(side(b, "b"), [*on, key])
    return both.withColumn("ratio", F.try_divide(f"a_{value}", F.col(f"b_{value}")))


def in_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys`` (all its columns)."""
    return df.join(keys, keys.columns, "left_semi")


def common_levels(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Sorted distinct values that both have."""
    return a.select(name).intersect(b.select(name)).orderBy(name)


def all_levels(name: str, *dfs: DataFrame) -> DataFrame:
    """Sorted distinct values of all."""
    out = dfs[0].select(name)
    for d in dfs[1:]:
        out = out.union(d.select(name))
    return out.distinct().orderBy(name)


def median_ratio(ratios: DataFrame, keys=("mu", "x_ratio"), value: str = "ratio") -> DataFrame:
    """The median ratio per key, by `grouped_median`; in no order."""
    return grouped_median(ratios, keys, F.col(value), value)


def ratio_matrix(long: DataFrame, levels, row: str = "delta", level: str = "mu", value: str = "ratio") -> DataFrame:
    """One row per ``row``, a column mu_<level> for each of ``levels`` (given, so no job finds them)."""
    named = long.withColumn("_col", F.concat(F.lit(f"{level}_"), F.format_string("%.1f", F.col(level).cast("double"))))
    return named.groupBy(row).pivot("_col", [f"{level}_{v:.1f}" for v in levels]).agg(F.first(value))
