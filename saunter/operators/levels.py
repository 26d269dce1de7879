"""Facets and styles: ranks over the distinct levels of a column, which are few, joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, name: str) -> DataFrame:
    distinct = df.select(name).where(F.col(name).isNotNull()).distinct()
    return distinct.withColumn("_rank", F.dense_rank().over(Window.orderBy(name)) - 1)  # one row per level


def facet_series(df: DataFrame, facet: str, max_facets: int | None = 4) -> DataFrame:
    """Adds facet_no (from 0) by the order of the facet's values; facets beyond ``max_facets`` go."""
    ranks = _ranked(df, facet)
    ranks = ranks if max_facets is None else ranks.where(F.col("_rank") < max_facets)
    return df.join(ranks, facet).withColumnRenamed("_rank", "facet_no")


def facet_grid(df: DataFrame, facet: str, order, ncols: int) -> DataFrame:
    """A row per listed facet and row of ``df``, in the caller's order; facets without rows stay, with nulls.

    Adds facet_no, grid_row and grid_col of a row-major grid.
    """
    kind = df.schema[facet].dataType.simpleString()
    listed = df.sparkSession.createDataFrame(list(enumerate(order)), f"facet_no int, `{facet}` {kind}")
    listed = listed.withColumn("grid_row", F.floor(F.col("facet_no") / ncols).cast("int")).withColumn("grid_col", F.col("facet_no") % ncols)
    return listed.join(df, facet, "left")


def style_index(df: DataFrame, category: str, palette: int) -> DataFrame:
    """Adds style: the category's rank modulo the number of styles."""
    return df.join(_ranked(df, category), category).withColumn("style", (F.col("_rank") % palette).cast("int")).drop("_rank")


def first_rows(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)
