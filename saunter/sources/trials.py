"""Trial tables: reading files of either variant, joining them by name, and writing them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saunter.functions.exprs import clean, fixed
from saunter.sources.schema import TYPES, VARIANTS, schema, schema_of_header

#: First lines of files that are read at a time.
READERS = 32


def require_columns(df: DataFrame, cols) -> DataFrame:
    """``df``, or an error that lists the missing columns; no job runs."""
    if missing := sorted(set(cols) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def with_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities in floating columns become null."""
    return df.select(*(clean(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields))


def union_trials(*dfs: DataFrame) -> DataFrame:
    """Rows of all, columns matched by name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that the paths (files, folders or globs) name, hidden ones and those of nested folders left out."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, set()
    for p in paths:
        where = hadoop.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(where) or []:
            for x in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
                if x.isFile() and x.getLen() and x.getPath().getName()[0] not in "._":
                    found.add(x.getPath().toString())
    return sorted(found)


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a file; no more than its first buffer is read."""
    io, where = spark._jvm.java.io, spark._jvm.org.apache.hadoop.fs.Path(file)
    lines = io.BufferedReader(io.InputStreamReader(where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where), "UTF-8"))
    try:
        return (lines.readLine() or "").strip()
    finally:
        lines.close()


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """header -> files, from the first line of each file. A file with a header of unknown columns is an error."""
    files = _files(spark, paths)
    with ThreadPoolExecutor(READERS) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    by_header: dict[str, list[str]] = {}
    for file, line in zip(files, lines):
        if not {c.strip() for c in line.split(",")} & TYPES.keys():
            raise ValueError(f"{file} has no header with known columns: {line[:200]!r}")
        by_header.setdefault(line, []).append(file)
    return by_header


def _unlike(spark: SparkSession, files: list[str]) -> list[str]:
    """Of files with the same content, the first by name. Only files of one length are hashed."""
    sizes = spark.read.format("binaryFile").load(files).select("path", "length").collect()  # a row per file; contents are not read
    by_size: dict[int, list[str]] = {}
    for r in sizes:
        by_size.setdefault(r["length"], []).append(r["path"])
    alone, some = ([p for ps in by_size.values() if (len(ps) > 1) == many for p in ps] for many in (False, True))
    if not some:
        return sorted(alone)
    seen = spark.read.format("binaryFile").load(some).groupBy(F.sha2("content", 256).alias("h")).agg(F.min("path").alias("path"))
    return sorted(alone + [r["path"] for r in seen.select("path").collect()])


def read_trials(spark: SparkSession, *paths: str, dedupe_files: bool = False) -> DataFrame:
    """Trials of all files under ``paths`` (files, folders or globs), whichever variant each is.

    Each header is scanned with its own types: one scan over both would match columns by
    place. ``dedupe_files`` leaves out files whose content another has (two launches of one
    configuration); equal rows in one file are separate trials and stay.
    """
    found = [spark.read.schema(schema_of_header(header)).option("header", True).csv(_unlike(spark, files) if dedupe_files else files)
             for header, files in sorted(_headers(spark, list(paths)).items())]
    return with_nulls(union_trials(*found)) if found else spark.createDataFrame([], schema("surface"))


def read_trial_file(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """One file; without a variant its types are inferred."""
    reader = spark.read.option("header", True)
    return with_nulls(reader.schema(schema(variant)).csv(path) if variant else reader.option("inferSchema", True).csv(path))


def trial_text(df: DataFrame, variant: str) -> DataFrame:
    """Every column as the fixed-decimal text of its variant."""
    require_columns(df, [n for n, _, _ in VARIANTS[variant]])
    text = lambda n, d: F.col(n).cast("string") if d in ("d", "s") else fixed(n, d)
    return df.select(*(text(n, d).alias(n) for n, _, d in VARIANTS[variant]))


def write_trials(df: DataFrame, path: str, variant: str = "surface") -> None:
    trial_text(df, variant).write.mode("overwrite").option("header", True).csv(path)


def write_store(df: DataFrame, path: str) -> None:
    """The internal store: Parquet by shape and mu, so that slices read their folders only."""
    df.repartition("TargetShape", "mu").write.mode("overwrite").partitionBy("TargetShape", "mu").parquet(path)


def write_ratio_matrix(wide: DataFrame, path: str, key: str = "delta") -> None:
    """A `ratio_matrix` as CSV, eight decimals."""
    cols = [c for c in wide.columns if c != key]
    wide.orderBy(key).select(fixed(key, 8).alias(key), *(fixed(f"`{c}`", 8).alias(c) for c in cols)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
