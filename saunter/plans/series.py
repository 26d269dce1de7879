"""Plot-ready series: facet, series, x, y[, y_err]. Each is one plan from trials to points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.functions import exprs as X
from saunter.operators import levels as L
from saunter.operators import normalize as N
from saunter.operators import stats as S
from saunter.sources.trials import require_columns


def _points(df: DataFrame, x: str, y: str, series, facet=None, err: str | None = None) -> DataFrame:
    cols = [(F.col(facet) if facet else F.lit(None)).cast("string").alias("facet"), series.cast("string").alias("series"), F.col(x).cast("double").alias("x"), F.col(y).alias("y")]
    return df.select(*cols, *([F.col(err).alias("y_err")] if err else []))


def time_vs_surface(trials: DataFrame, mu: float, n_volume: float, probability: float, n_targets: int, n_walkers: int, strict: bool = False) -> DataFrame:
    """Mean detection time by surface, a series per shape, and the theory on all surfaces that occur."""
    some = S.checked(S.slice_eq(trials, {"mu": mu, "n_volume": n_volume, "probability": probability, "n_targets": n_targets, "n_walkers": n_walkers}), strict)
    means = S.cond_mean(some, ["TargetShape", "surface"])
    theory = N.all_levels("surface", means).withColumn("y", X.theory_time(F.lit(n_volume), "surface"))
    return _points(means, "surface", "detection_time", F.col("TargetShape")).unionByName(_points(theory, "surface", "y", F.lit("theory")))


def _by_mu(trials: DataFrame, n_walkers, n_volume, n_targets, probability, shapes, surfaces) -> tuple[DataFrame, list[str]]:
    fixed = {"n_walkers": n_walkers, "n_volume": n_volume, "n_targets": n_targets, "probability": probability}
    some = S.slice_in(S.large_surfaces(S.slice_eq(trials, fixed), surfaces), "TargetShape", shapes)
    keys = S.group_keys(fixed)
    return S.cond_mean(some, keys), keys


def _series_name():
    return F.concat_ws(" ", X.shape_label("TargetShape"), F.col("surface").cast("long").cast("string"))


def ratio_vs_mu(trials: DataFrame, n_walkers, n_volume=None, n_targets=None, probability=None, shapes=None, surfaces=None, base: float = 2.0) -> DataFrame:
    """Mean detection time over that at mu = base, by mu; a series per shape and surface."""
    means, keys = _by_mu(trials, n_walkers, n_volume, n_targets, probability, shapes, surfaces)
    ratios = N.ratio_to_baseline(means, [k for k in keys if k != "mu"], base=base)
    return _points(ratios, "mu", "ratio", _series_name())


def time_vs_mu(trials: DataFrame, n_walkers, n_volume=None, n_targets=None, probability=None, shapes=None, surfaces=None) -> DataFrame:
    """Mean detection time by mu; a series per shape and surface."""
    means, _ = _by_mu(trials, n_walkers, n_volume, n_targets, probability, shapes, surfaces)
    return _points(means, "mu", "detection_time", _series_name())


def ball_ratio_vs_size(trials: DataFrame, n_walkers, n_targets, fixed_target_dist, probability, mus, reference_shape: str = "Disk", reference: str = "DiskDiameter", strict: bool = False) -> DataFrame:
    """Median time of balls over that of the reference shape at equal sizes, a series per mu, with theory for mu = 2."""
    require_columns(trials, [reference])
    fixed = {"n_walkers": n_walkers, "n_targets": n_targets, "fixed_target_dist": fixed_target_dist, "probability": probability}
    some = S.checked(S.slice_in(S.slice_eq(trials, fixed), "mu", mus), strict)
    medians = S.cond_median(some, ["mu", "TargetShape", reference, "D"])
    ratios = N.ratio_between(medians, "Ball_no_boundary", reference_shape, ["mu"], reference, carry=("D",))
    curve = reference_shape if reference_shape != "Line" else "Line_volume" if reference == "surface" else "Line_area"
    if reference == "surface" and reference_shape != "Line":
        raise ValueError(f"no curve for reference {reference_shape!r} by surface")
    theory = ratios.where(F.col("mu") == 2).withColumn("y", X.reference_curve(curve, F.col(reference), F.col("b_D"), F.col("a_D")))
    return _points(ratios, reference, "ratio", F.format_string("mu=%.1f", F.col("mu"))).unionByName(_points(theory, reference, "y", F.lit("theory")))


def time_vs_delta(trials: DataFrame, mus, diameters, max_facets: int = 4) -> DataFrame:
    """Mean detection time by delta, a series per mu, a facet per D; facets beyond ``max_facets`` go."""
    require_columns(trials, ["delta", "detection_time", "mu", "D"])
    means = S.cond_mean(S.slice_in(S.slice_in(trials, "mu", mus), "D", diameters), ["mu", "delta", "D"])
    faceted = L.facet_series(means, "D", max_facets)
    return _points(faceted, "delta", "detection_time", F.format_string("mu=%.1f", F.col("mu")), "D")


def ratio_vs_elongation(trials: DataFrame, mus, surfaces, baseline: float = 2.0, group_cols=None, agg: str = "mean", ncols: int = 3, strict: bool = False) -> DataFrame:
    """Median ratio to the baseline mu by x1, a series per lower mu, a facet per surface in the caller's order.

    ``group_cols`` defaults to the wide keys, which hold touch steps of single trials: with
    these few trials have a partner. Facets without a match stay, with nulls.
    """
    keys = list(S.WIDE_KEYS if group_cols is None else group_cols)
    require_columns(trials, {*keys, "mu", "surface", "delta", "detection_time"})
    if baseline not in list(mus):
        raise ValueError(f"the baseline {baseline} is not among the requested levels {sorted(mus)}")
    some = S.checked(S.slice_in(S.slice_in(trials, "mu", mus), "surface", surfaces), strict)
    grouped = S.with_elongation(S.cond_agg(some, [*keys, "mu"], agg))
    ratios = N.ratio_below_baseline(grouped, [*keys, "x_ratio"], mus, base=baseline)
    medians = N.median_ratio(ratios, ["surface", "mu", "x_ratio"])
    grid = L.facet_grid(medians, "surface", [float(s) for s in surfaces], ncols)
    return grid.select("facet_no", "grid_row", "grid_col", F.col("surface").alias("facet"), F.col("mu").alias("series"), F.col("x_ratio").alias("x"), F.col("ratio").alias("y"))


def validation_summary(trials: DataFrame, key: str = "delta", level: str = "mu", target: float = 2.0, on_bad: str = "zero") -> DataFrame:
    """Per (key, level): n, mean, std, sem, and the ratio to the level nearest to the target with its error."""
    return N.ratio_with_error(S.cond_summary(trials, [key, level]), [key], level, target, on_bad)
