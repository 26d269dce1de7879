"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

Only ids and digests are grouped at first. Texts move for the rows of groups of two or more (and
for few others, by chance of the bitmap in `shared.split_likely`), and arrive pre-aggregated: a
task sends one smallest and one largest text for each group, so a group that holds a third of all
rows costs one row per task. Such a group's result reaches its rows by a broadcast of few keys.

Defined results
* Null text counts as the empty text; two empty texts are equal.
* Null ids never win over an id; in a group with null ids only, ``keep_id`` is null.
* Rows that repeat an id and a text are one row seen twice: marked alike by
  ``mark_duplicates``, kept once by ``drop_duplicates``.
* An empty table gives an empty result. Further columns pass through ``drop_duplicates``
  untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saunter.llm.shared import columns_of, free_name, join_groups, likely, split_likely, staged, text_of


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                    content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep``: "smallest" or "largest" id of a group stays. ``content_hash`` is the grouping
    hash; any weaker one gives the same result, as equal hashes are checked byte by byte.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    base = base.withColumn("_hash", content_hash(F.col("_text")))
    slim = staged(base.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256")))
    groups = slim.groupBy("_hash").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    shared = staged(groups.where("group_size > 1").select("_hash"))
    extremes = likely(base, shared, ["_hash"]).groupBy("_hash").agg(F.min("_text").alias("lo"), F.max("_text").alias("hi"))
    collided = staged(extremes.where("lo <> hi").select("_hash"))

    def marked(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

    if collided.isEmpty():
        return marked(join_groups(slim, groups, ["_hash"], "group_size"))
    unlike = base.join(collided, "_hash", "left_semi")
    by_text = unlike.groupBy("_text").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    apart = unlike.withColumn("text_sha256", F.sha2("_text", 256)).join(by_text, "_text")
    return marked(join_groups(staged(slim.join(collided, "_hash", "left_anti")), groups, ["_hash"], "group_size")).unionByName(marked(apart))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that have no copy are not shuffled."""
    sha, gone_id = free_name(docs, "dedup_sha"), free_name(docs, "dedup_id")
    marks = staged(mark_duplicates(docs, id_col, text_col, keep).where("group_size > 1").select(F.col(id_col).alias(gone_id), F.col("text_sha256").alias(sha), "kept"))
    some, alone = split_likely(docs.withColumn(sha, F.sha2(text_of(text_col), 256)), marks, [sha])
    gone = marks.where("not kept").drop("kept").distinct().alias("g")
    stay = some.alias("d").join(gone, F.col(f"d.{id_col}").eqNullSafe(F.col(f"g.{gone_id}")) & (F.col(f"d.{sha}") == F.col(f"g.{sha}")), "left_anti")
    return alone.unionByName(stay.dropDuplicates([id_col, sha])).select(*columns_of(docs))
