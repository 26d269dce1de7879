"""Parameter grids: expansion, validity and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saunter.functions import exprs as X

#: The order in which lists are expanded, and the column of each.
SURFACE_ORDER = [("range_side", "side"), ("rangemu_LevyDistrib", "mu"), ("list_shapes", "TargetShape"), ("range_diam", "range_diam"), ("range_ntargets", "n_targets"),
                 ("range_nwalkers", "n_walkers"), ("range_probability", "probability"), ("range_delta", "delta")]
VOLUME_ORDER = [("range_side", "side"), ("rangemu_LevyDistrib", "mu"), ("range_disk_diameter", "DiskDiameter"), ("range_ntargets", "n_targets"),
                ("range_nwalkers", "n_walkers"), ("list_shapes", "TargetShape")]


def expand_cells(params: DataFrame, order) -> DataFrame:
    """One row per combination of the lists, with cell_id in the order of the loops. A missing list is one null."""
    out = params.withColumn("cell_id", F.lit(0).cast("long"))
    for source, name in order:
        values = F.coalesce(F.col(source), F.array(F.lit(None).cast(params.schema[source].dataType.elementType)))
        rest = [c for c in out.columns if c not in (source, "cell_id")]
        out = out.select(*rest, "cell_id", F.size(values).alias("_n"), F.posexplode(values).alias("_at", name))
        out = out.withColumn("cell_id", F.col("cell_id") * F.col("_n") + F.col("_at")).drop("_n", "_at")
    return out


def surface_cells(params: DataFrame) -> DataFrame:
    """Cells of the surface grid with D: by selector from surface, projected surface or diameter."""
    cells = expand_cells(params, SURFACE_ORDER)
    return (cells.withColumn("n_volume", X.volume_from_side("side")).withColumn("lmax", F.col("l_max").cast("int"))
            .withColumn("D", X.diameter("surface_selector", "range_diam", "TargetShape")).withColumnRenamed("range_diam", "surface"))


def volume_cells(params: DataFrame) -> DataFrame:
    """Cells of the fixed-volume grid; lmax is half the side. Shapes that it doesn't run go."""
    cells = expand_cells(params, VOLUME_ORDER)
    d = X.diameter_fixed_volume("DiskDiameter", "TargetShape", F.col("reference_shape"))
    return cells.withColumn("n_volume", X.volume_from_side("side")).withColumn("lmax", (F.col("side") / 2).cast("int")).withColumn("D", d).where("D is not null")


def is_valid(d="D", side="side", selector="delta_selector") -> Column:
    """Elongation studies are always valid; otherwise 1 <= D <= side."""
    s = F.coalesce(F.col(selector), F.lit(0))
    return (s == 1) | ((s == 0) & (F.col(d) >= 1) & (F.col(d) <= F.col(side)))


def valid_cells(cells: DataFrame) -> DataFrame:
    return cells.where(is_valid())


def cell_results(cells: DataFrame, stats: DataFrame, on, value: str = "mean", keep_invalid: bool = False) -> DataFrame:
    """Each cell with its statistic; an invalid cell has none. Cells without a result go unless kept."""
    out = cells.join(stats.select(*on, F.col(value).alias("_v")), list(on), "left")
    out = out.withColumn(value, F.when(is_valid(), F.col("_v"))).drop("_v")
    return out if keep_invalid else out.where(F.col(value).isNotNull())


def expand_grid(cells: DataFrame, num_runs: str | int = "num_runs") -> DataFrame:
    """One row per cell and repeat, from run 1."""
    runs = F.col(num_runs) if isinstance(num_runs, str) else F.lit(num_runs)
    return cells.where(runs >= 1).withColumn("run", F.explode(F.sequence(F.lit(1), runs)))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Cells, valid cells and expected rows per experiment."""
    ok = is_valid().cast("long")
    return cells.groupBy("experiment").agg(F.count("*").alias("cells"), F.sum(ok).alias("valid"), F.sum(ok * F.col("num_runs")).alias("expected_rows"))


def grid_coverage(cells: DataFrame, trials: DataFrame, on, num_runs: str | int = "num_runs") -> DataFrame:
    """Per cell: rows expected, present and missing, and the share present in percent."""
    expected = (F.col(num_runs) if isinstance(num_runs, str) else F.lit(num_runs)).cast("long")
    present = trials.dropna(subset=list(on)).groupBy(*on).agg(F.count("*").alias("_actual"))
    out = cells.join(present, list(on), "left").withColumn("expected", expected).withColumn("actual", F.coalesce("_actual", F.lit(0).cast("long"))).drop("_actual")
    out = out.withColumn("missing", F.greatest(F.col("expected") - F.col("actual"), F.lit(0).cast("long")))
    return out.withColumn("pct", F.try_divide(100.0 * F.col("actual"), F.col("expected")))


#: What a trial of each variant is matched on, when the coverage of configurations is asked for.
SURFACE_KEYS = ["mu", "surface", "TargetShape", "probability"]
VOLUME_KEYS = ["mu", "DiskDiameter", "TargetShape"]


def config_coverage(configs: DataFrame, trials: DataFrame, surface_keys=SURFACE_KEYS, volume_keys=VOLUME_KEYS) -> DataFrame:
    """Coverage of all configurations, of either variant, by one table of trials: variant, experiment, the keys, expected, actual, missing, pct.

    A configuration with disk diameters is one of fixed volume, whose cells are all run; others run their valid cells.
    A trial counts for the variant whose keys it has; a cell that several configurations ask for is listed under each.
    """
    fixed, keys = F.col("range_disk_diameter").isNotNull(), list(dict.fromkeys([*surface_keys, *volume_keys]))
    parts = []
    for variant, cells, on in (("surface", valid_cells(surface_cells(configs.where(~fixed))), surface_keys), ("fixed_volume", volume_cells(configs.where(fixed)), volume_keys)):
        found = grid_coverage(cells.select("experiment", "num_runs", *on), trials, on)
        parts.append(found.select(F.lit(variant).alias("variant"), "experiment", *on, "expected", "actual", "missing", "pct"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select("variant", "experiment", *keys, "expected", "actual", "missing", "pct")
