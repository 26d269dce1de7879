"""Near duplicates by fast similarity sketching, banding and verification on whole sets.

A sketch has ``BINS`` coordinates. Round i throws every element of a set into a bin by a hash of its own, with the value
i and a fraction; a bin keeps its smallest value. In the first ``BINS`` rounds bins are drawn, in the ``BINS`` rounds behind them
round i throws all into bin i: so every coordinate fills, and it stops when all have. Two sets agree on a
coordinate with the probability of their similarity, and the number of agreements is concentrated as if coordinates
were drawn alone. A large set fills its bins in the first round or two, at one hash an element.

Classes of equal sets are the rows; ``ROWS`` coordinates make a band, and classes with an equal band are candidates. A
pair of similarity s shares none of the bands with probability (1 - s^ROWS)^(BINS / ROWS): 6e-9 at 0.85. A band's smallest class is
its leader, found by partial aggregation, so a band with a third of all classes is not held anywhere. Leaders are compared
with those they lead on whole sets; the members of groups which that doesn't join go on as in `ngram_join`: no
candidate pair of different components is left out, and none that may be a link is left unverified.

Defined results: a text without words has an empty set and is linked with nothing; repeated rows and equal texts are of one
class; a null id takes part, but never is a component's id while there is another; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.ngram_join import STEP, _sets, classes_of, joined_classes, packed, signature
from saunter.llm.rtree import group_counts
from saunter.llm.shared import Scratch, likely
from saunter.llm.words import mixed

SHINGLE, PERCENT = 3, 85
BINS, ROWS = 240, 6
#: Elements that are thrown at a time: small sets go through several rounds at once.
THROWN = 2048
_LOW = np.uint64(0xFFFFFFFF)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The coordinates of a set of 64-bit hashes; of an empty set none is filled (all bits set).

    Rounds beyond the one that fills the last bin change nothing, as their values are larger.
    """
    least = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    at, n = 0, max(1, THROWN // max(1, len(elements)))
    while len(elements) and at < 2 * bins:
        rounds = np.arange(at, min(at + n, 2 * bins if at >= bins else bins), dtype=np.uint64)
        hashes = mixed(elements[None, :] ^ mixed((rounds + np.uint64(1)) * STEP)[:, None])
        values = rounds[:, None] << np.uint64(32) | hashes & _LOW
        if at < bins:
            np.minimum.at(least, (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64).ravel(), values.ravel())
        else:
            own = np.arange(at - bins, at - bins + len(rounds))
            least[own] = np.minimum(least[own], values.min(axis=1))
        at += len(rounds)
        if (least >> np.uint64(32)).max() < at:
            break
    return least


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of a sketch, the band's place included."""
    table = least[: len(least) // rows * rows].reshape(-1, rows)
    total = mixed(np.arange(1, len(table) + 1, dtype=np.uint64) * STEP)
    for k in range(rows):
        total = mixed(total * STEP ^ table[:, k])
    return total


def _profile(docs: DataFrame, size: int, id_type: str) -> DataFrame:
    """(id, n, sig, point, bands) per document."""
    def run(batches):
        for b, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([packed(group_counts(s)) for s in sets], pa.binary()),
                 pa.array([bands(sketch(s)).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))], names=["id", "n", "sig", "point", "bands"])

    return docs.mapInArrow(run, f"id {id_type}, n long, sig binary, point binary, bands array<long>")


def sketch_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links of at least ``percent`` similarity)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    stage = Scratch(slim.sparkSession)
    profile = stage(_profile(slim, size, slim.schema["id"].dataType.simpleString()))
    classes = stage(classes_of(profile, "bands"))
    held = classes.select("sig", F.explode("bands").alias("band"))
    leads = stage(held.groupBy("band").agg(F.min("sig").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a"))
    stars = stage(likely(held, leads, ["band"]).join(leads, "band").where("a <> sig").select("a", F.col("sig").alias("b")).distinct())
    found = joined_classes(slim, profile.drop("bands"), classes.drop("bands"), stars, size, percent, stage)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id")
