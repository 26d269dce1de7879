"""Queries through files: trial tables, configurations, ratio files and appended streams, written and read back.

Each writes what it makes of the given tables below the shared folder, reads that with the
library's own sources, and is compared with SQL over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saunter.operators import grid as G
from saunter.operators import normalize as N
from saunter.operators import stats as S
from saunter.plans import series as J
from saunter.plans.queries import MUS, ORACLES, QUERIES, _with, rounded, view
from saunter.sources import grids, trials
from saunter.sources.folders import shared_dir
from saunter.streaming import live


def _new_path(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, name)


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The trial table as files of the surface variant, and orders as files of the fixed-volume variant."""
    path = _new_path(spark, "trial_files")
    trials.write_trials(view(spark, sf_dir, "trials"), f"{path}/surface")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    other = orders.select(
        F.lit(1).alias("n_walkers"), F.lit(134217728.0).alias("n_volume"), F.lit(2.0).alias("mu"), F.lit(256).alias("lmax"), F.lit(5.25).alias("D"), F.lit("Disk").alias("TargetShape"),
        (F.col("o_orderkey") % 7).cast("double").alias("DiskDiameter"), F.lit(1).alias("n_targets"), F.lit(0.0).alias("fixed_target_dist"), F.col("o_totalprice").alias("detection_time"), F.lit(1.0).alias("probability"))
    trials.write_trials(other, f"{path}/volume", "fixed_volume")
    return path


def trial_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of both variants under two folders, read as one table by name."""
    path = _written(spark, sf_dir)
    read = trials.require_columns(trials.read_trials(spark, f"{path}/surface", f"{path}/vol*/*.csv"), ["TargetShape", "surface", "DiskDiameter", "detection_time"])
    return read.groupBy("TargetShape").agg(F.count("*").alias("n"), F.count("surface").alias("with_surface"), F.count("DiskDiameter").alias("with_disk"), F.round(F.sum("detection_time"), 2).alias("total"))


def trial_folder_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one variant, their types inferred."""
    read = trials.read_trial_file(spark, f"{_written(spark, sf_dir)}/surface")
    return read.groupBy("mu", "TargetShape").agg(F.count("*").alias("n"), F.max("surface").alias("surface"), F.round(F.avg("detection_time"), 4).alias("mean"))


def _surface_configs(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A configuration file per shape below ``path``, with the levels that occur and one that doesn't."""
    levels = view(spark, sf_dir, "trials").groupBy("TargetShape").agg(F.sort_array(F.collect_set("mu")).alias("mu"), F.sort_array(F.collect_set("surface")).alias("surface"))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    lines = F.array(
        F.lit("# levels of one shape"), F.lit(""), F.lit("surface_selector=1"), F.lit("delta_selector=0"), F.lit("num_runs=7"), F.lit("num_runs=30"), F.lit("l_max=256"), F.lit("range_side=512"),
        F.concat(F.lit("rangemu_LevyDistrib= "), listed("mu")), F.concat(F.lit("range_diam="), listed("surface"), F.lit(",300000.0")), F.concat(F.lit("list_shapes="), F.col("TargetShape"), F.lit(",")),
        F.lit("range_nwalkers=1"), F.lit("range_ntargets=1"), F.lit("range_probability=0.5,1.0"), F.lit("range_delta=0.5"), F.lit("not_a_key=1"))
    levels.select("TargetShape", F.array_join(lines, "\n").alias("value")).write.partitionBy("TargetShape").text(path)


def config_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files, one per shape with the levels that occur, read and expanded."""
    path = _new_path(spark, "configs")
    _surface_configs(spark, sf_dir, path)
    cells = G.surface_cells(grids.read_grids(spark, f"{path}/TargetShape=*"))
    counts = G.cell_counts(cells)
    return counts.select(F.regexp_extract("experiment", "TargetShape=([^/]+)/", 1).alias("experiment"), "cells", "valid", "expected_rows")


def config_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files of both variants, and how far the trial files of both cover them."""
    path, files = _new_path(spark, "all_configs"), _written(spark, sf_dir)
    _surface_configs(spark, sf_dir, path)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 7).alias("d"), (1 + F.col("o_orderkey") % 3 / 2).alias("mu"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("double"))).cast("array<string>"), ",")
    lines = orders.agg(listed("d").alias("d"), listed("mu").alias("mu")).select(F.concat_ws(
        "\n", F.lit("# one volume"), F.lit("reference_shape=Disk"), F.lit("num_runs=200"), F.lit("range_side=512"), F.concat(F.lit("rangemu_LevyDistrib="), "mu"),
        F.concat(F.lit("range_disk_diameter="), "d", F.lit(",9.0")), F.lit("list_shapes=Disk,Ball_no_boundary,Line"), F.lit("range_nwalkers=1"), F.lit("range_ntargets=1")).alias("value"))
    lines.write.text(f"{path}/TargetShape=any")
    read = trials.read_trials(spark, f"{files}/surface", f"{files}/volume")
    found = G.config_coverage(grids.read_grids(spark, f"{path}/TargetShape=*"), read)
    return rounded(found.withColumn("experiment", F.regexp_extract("experiment", "TargetShape=([^/]+)/", 1)))


def ratio_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide ratio matrix, written with eight decimals and read back."""
    path = _new_path(spark, "ratios")
    trials.write_ratio_matrix(N.ratio_matrix(J.validation_summary(view(spark, sf_dir, "trials")), MUS), path)
    names = [f"mu_{m}" for m in MUS]
    read = spark.read.schema(", ".join(f"`{c}` double" for c in ("delta", *names))).option("header", True).csv(path)
    return read.select("delta", *(F.round(F.col(f"`{c}`"), 6).alias(c) for c in names))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The internal store, and a slice of it that reads the folders of one shape and two levels."""
    path = _new_path(spark, "store")
    trials.write_store(view(spark, sf_dir, "trials"), path)
    some = S.slice_in(S.slice_eq(spark.read.parquet(path), {"TargetShape": "Line"}), "mu", [1.0, 2.0])
    return rounded(S.cond_summary(some, ["mu", "surface"]), 4)


def live_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial files appended by a stream to a durable table, summed up from there."""
    path = _new_path(spark, "live_append")
    trials.write_trials(view(spark, sf_dir, "trials"), f"{path}/files")
    live.append_trials(live.trial_stream(spark, f"{path}/files"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return rounded(S.cond_summary(spark.read.parquet(f"{path}/table"), ["delta", "mu"]), 4)


def live_append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial files appended by content; all batches then run once more, as after a lost checkpoint, and add nothing."""
    path = _new_path(spark, "live_append_twice")
    text = trials.trial_text(view(spark, sf_dir, "trials"), "surface")
    text.write.option("header", True).option("maxRecordsPerFile", 100_000).csv(f"{path}/files")
    for run in ("first", "again"):
        live.append_files(spark, f"{path}/files", f"{path}/table", f"{path}/{run}").awaitTermination()
    return rounded(S.cond_summary(spark.read.parquet(f"{path}/table"), ["delta", "mu"]), 4)


QUERIES |= {f.__name__: f for f in (trial_files, trial_folder_inferred, config_grids, config_coverage, ratio_file, store_round_trip, live_append, live_append_twice)}
ORACLES |= {
    "trial_files": _with("trials") + """ SELECT TargetShape, COUNT(*) AS n, COUNT(surface) AS with_surface, COUNT(DiskDiameter) AS with_disk, ROUND(SUM(t), 2) AS total FROM (
        SELECT TargetShape, surface, NULL AS DiskDiameter, detection_time AS t FROM trials
        UNION ALL SELECT 'Disk', NULL, CAST(o_orderkey % 7 AS DOUBLE), o_totalprice FROM orders) GROUP BY TargetShape""",
    "trial_folder_inferred": _with("trials") + " SELECT mu, TargetShape, COUNT(*) AS n, MAX(surface) AS surface, ROUND(AVG(detection_time), 4) AS mean FROM trials GROUP BY mu, TargetShape",
    "config_grids": ORACLES["grid_cells"],
    "config_coverage": f"""SELECT 'surface' AS variant, experiment, mu, surface, TargetShape, probability, CAST(NULL AS DOUBLE) AS DiskDiameter, expected, actual, missing, pct FROM (
            {ORACLES["grid_coverage"].replace("SELECT c.mu, c.surface", "SELECT c.experiment, c.mu, c.surface")})
        UNION ALL SELECT 'fixed_volume', 'any', mu, NULL, shape, NULL, d, 200, COALESCE(n, 0), GREATEST(200 - COALESCE(n, 0), 0), ROUND(100.0 * COALESCE(n, 0) / 200, 6)
        FROM (SELECT DISTINCT 1 + (o_orderkey % 3) / CAST(2 AS DOUBLE) AS mu FROM orders), (SELECT DISTINCT CAST(o_orderkey % 7 AS DOUBLE) AS d FROM orders UNION SELECT 9), (VALUES ('Disk'), ('Ball_no_boundary')) v(shape)
        LEFT JOIN (SELECT 2.0 AS k_mu, CAST(o_orderkey % 7 AS DOUBLE) AS k, 'Disk' AS k_shape, COUNT(*) AS n FROM orders GROUP BY ALL) ON mu = k_mu AND d = k AND shape = k_shape""",
    "ratio_file": ORACLES["ratio_matrix_wide"],
    "store_round_trip": _with("trials") + """ SELECT mu, surface, COUNT(*) AS n, ROUND(AVG(detection_time), 4) AS mean, ROUND(CASE WHEN COUNT(*) = 1 THEN 0 ELSE STDDEV_SAMP(detection_time) END, 4) AS std,
        ROUND(CASE WHEN COUNT(*) = 1 THEN 0 ELSE STDDEV_SAMP(detection_time) END / SQRT(COUNT(*)), 4) AS sem FROM trials WHERE TargetShape = 'Line' AND mu IN (1.0, 2.0) GROUP BY mu, surface""",
    "live_append": ORACLES["cond_summary"],
    "live_append_twice": ORACLES["cond_summary"],
}
