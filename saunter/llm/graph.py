"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.shared import staged


def components(links: DataFrame, stage=staged) -> DataFrame:
    """(v, comp): for each vertex of ``links`` (a, b) the smallest vertex it is connected with.

    Labels spread to neighbours and then jump to what their label's label was; both steps are
    joins on keys of staged tables (of a hub's links Spark makes several tasks when it runs), and
    each round is one staged table. It ends when no label changes.

    Defined results: a link of a vertex with itself gives it a row; repeated links are one; null
    ends are no vertices, and a link that has one is left out; no links give no rows.
    """
    known = links.select("a", "b").where("a is not null and b is not null")
    both = stage(known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")))
    while True:
        # No column of labels is renamed below a join: so the plan shuffles (or broadcasts) them once for all three.
        near = both.join(labels.alias("n"), F.col("b") == F.col("n.v")).groupBy("a").agg(F.min("n.comp").alias("m"))
        spread = labels.alias("o").join(near, F.col("o.v") == F.col("a")).select(F.col("o.v").alias("w"), F.col("o.comp").alias("old"), F.least("o.comp", "m").alias("l"))
        jump = spread.join(labels.alias("j"), F.col("l") == F.col("j.v"), "left")
        new = stage(jump.select(F.col("w").alias("v"), "old", F.least("l", "j.comp").alias("comp")))
        labels = new.select("v", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
