"""Configuration files as a table: any number of ``key=v1,v2`` files in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys and their types. Other keys are ignored.
SCALARS = {"surface_selector": "int", "delta_selector": "int", "steps_between": "int", "max_touches": "int", "num_runs": "int", "l_max": "double",
           "reference_shape": "string", "save_directory": "string", "file_name": "string"}
LISTS = {"rangemu_LevyDistrib": "double", "range_diam": "double", "range_disk_diameter": "double", "range_delta": "double", "range_probability": "double",
         "range_side": "int", "range_nwalkers": "int", "range_ntargets": "int", "list_shapes": "string"}


def read_grid_values(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, key, raw): comment and blank lines skipped, the last value of a key wins: by its part of the file, then its line there."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("experiment"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    pairs = lines.where(~F.col("value").startswith("#") & (F.length("value") >= 2) & F.col("value").contains("=")).select(
        "experiment", F.struct("block", "n").alias("n"), F.trim(F.substring_index("value", "=", 1)).alias("key"), F.ltrim(F.expr("substring(value, instr(value, '=') + 1)")).alias("raw"))
    return pairs.groupBy("experiment", "key").agg(F.max_by("raw", "n").alias("raw"))


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: experiment, the scalars, and the lists as typed arrays (missing: null).

    A list's trailing comma leaves a blank entry: kept for shapes, null for numbers.
    """
    wanted = [*SCALARS, *LISTS]
    wide = read_grid_values(spark, path).where(F.col("key").isin(wanted)).groupBy("experiment").pivot("key", wanted).agg(F.first("raw"))
    scalars = [F.expr(f"try_cast(trim({k}) as {t})").alias(k) for k, t in SCALARS.items()]
    lists = [F.transform(F.split(k, ","), (lambda t: lambda v: F.trim(v) if t == "string" else F.trim(v).try_cast(t))(t)).alias(k) for k, t in LISTS.items()]
    return wide.select("experiment", *scalars, *lists)
