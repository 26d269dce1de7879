"""Passages that stand in more than one place, wherever their lines begin and end.

A window is ``least`` consecutive words (normalised as in `line_dedup`; lines don't matter). A
window that equals an earlier one, by (id, row, place), is a repeat; the repeats of a text that
overlap or touch form one passage. The first occurrence of every window stays. Where a window
overlaps its own first occurrence, only what lies behind that one is a repeat.

No window is lost and few are shuffled. Each text gives anchors, the smallest hash among ``WITHIN``
neighbouring grams of ``least - WITHIN + 1`` words; equal windows have equal anchors. Anchors of
one text whose earliest occurrences lie in one other place, equally far apart, and whose grams
touch make a chain: all windows in it are repeats. Only windows at the ends of chains, and those
where their anchors stand first, are hashed (128 bits) and grouped. Texts go through one shuffle.
A hash with very many rows is not dealt out (`shared.join_groups`).

Defined results: a null text has no words; null ids rank last; texts below ``least`` words have
no passage.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saunter.llm.shared import join_groups, staged
from saunter.llm.words import spaced_words

LEAST_WORDS = 50
#: Grams of a window, of which the smallest is its anchor; at most half of ``least``, so that neighbours' grams touch.
WITHIN = 25
#: Words whose hashes a worker keeps.
MOST_WORDS = 500_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """word -> 128 bits, as two numbers."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        raw = hashlib.md5(word).digest()
        two = self[word] = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")
        return two

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.array([self[w] for w in words], np.uint64).reshape(-1, 2).T


def rolled(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash per run of ``size`` words: a polynomial in ``base``, mod 2^64, by Horner's rule over doubled lengths."""
    out, have, power = np.zeros(len(hashes) + 1, np.uint64), 0, 1
    part, step, factor = hashes, 1, base  # part[i]: words i to i + step
    while size:
        if size & 1:
            n = len(hashes) - have - step + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out, have, power = out[:n] + np.uint64(power) * part[have : have + n], have + step, power * factor % 2**64
        size >>= 1
        if size:
            part = part[: len(part) - step] + np.uint64(factor) * part[step:] if len(part) > step else np.zeros(0, np.uint64)
            step, factor = 2 * step, factor * factor % 2**64
    return out


def anchors_of(hashes: np.ndarray, least: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some ``within`` neighbours."""
    grams = rolled(hashes, least - within + 1, BASES[0])
    grams ^= grams >> np.uint64(29)
    if len(grams) < within:
        return np.zeros(0, np.int64), grams[:0]
    at = np.unique(np.lib.stride_tricks.sliding_window_view(grams, within).argmin(axis=1) + np.arange(len(grams) - within + 1))
    return at, grams[at]


def word_edges(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in code points."""
    raw = text.encode()
    edges = np.array([m.span() for m in WORD.finditer(raw)], np.int64).reshape(-1, 2)
    if len(raw) != len(text):
        edges = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[edges]
    return edges[:, 0], edges[:, 1]


def _anchors(docs: DataFrame, least: int, within: int, kind: str) -> DataFrame:
    """(id, row, at, gram) of every anchor."""
    def run(batches):
        known = Hashes()
        for b in batches:
            rows, ats, grams = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k, (row, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                words = spaced_words((text or "").encode())
                if len(words) >= least:
                    at, gram = anchors_of(known.of(words)[0], least, within)
                    rows.append((k, row, len(at)))
                    ats.append(at)
                    grams.append(gram)
            place, row = np.repeat(np.array([x[:2] for x in rows], np.int64).reshape(-1, 2), [x[2] for x in rows], axis=0).T
            yield pa.RecordBatch.from_pydict({"id": b.column(1).take(pa.array(place)), "row": row.copy(), "at": np.concatenate(ats).astype(np.int32), "gram": np.concatenate(grams).view(np.int64)})

    return docs.select("row", "id", "text").mapInArrow(run, f"id {kind}, row long, at int, gram long")


def _chains(anchors: DataFrame, least: int, within: int) -> DataFrame:
    """(row, gram, at, keep, low, high): anchors that occur twice, with the first place and the words of their chain (null for that place)."""
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "row", "at")
    twice = anchors.groupBy("gram").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).where("n > 1")
    met = join_groups(anchors, twice, ["gram"]).select("row", "gram", "at", "keep").repartition("row")
    shift, size = F.col("at") - F.col("keep.at"), least - within + 1
    line = Window.partitionBy("row", "keep.row", "shift")
    met = met.withColumn("shift", shift).withColumn("far", F.coalesce(F.col("at") - F.lag("at").over(line.orderBy("at")) > within, F.lit(True)).cast("int"))
    met = met.withColumn("chain", F.sum("far").over(line.orderBy("at")))
    whole, first = Window.partitionBy("row", "keep.row", "shift", "chain"), (F.col("row") == F.col("keep.row")) & (F.col("shift") == 0)
    low, high = F.min("at").over(whole), F.max("at").over(whole) + size
    return met.select("row", "gram", "at", "keep", F.when(~first, low).alias("low"), F.when(~first, high).alias("high"))


def _windows(hits: DataFrame, least: int, within: int, kind: str) -> DataFrame:
    """(id, row, at, last, start, end, a, b, keep_id, keep_row, keep_at, keep_end): chains, and windows around
    open anchors that no chain holds. ``last`` is the first word behind; a and b are null for chains, what is kept for windows.
    """
    def run(batches):
        known = Hashes()
        for b in batches:
            for k in range(b.num_rows):
                row, text = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                hashes = known.of(spaced_words(text.encode()))
                grams, near = rolled(hashes[0], least - within + 1, BASES[0]), np.zeros(hashes.shape[1] - least + 1, bool)
                grams = (grams ^ (grams >> np.uint64(29))).view(np.int64)
                for x in b.column(4)[k].as_py() or ():
                    if grams[x["at"]] != x["gram"]:
                        raise ValueError("the rows of the documents changed their order between two scans")
                    near[max(0, x["at"] - within + 1) : x["at"] + 1] = True
                chains = b.column(3)[k].as_py() or []
                for c in chains:
                    near[c["low"] : c["high"] - least + 1] = False
                at, n = np.flatnonzero(near), len(chains)
                start, end = word_edges(text)
                low, last = np.array([c["low"] for c in chains], np.int64), np.array([c["high"] for c in chains], np.int64)
                all_at, all_last = np.concatenate((low, at)), np.concatenate((last, at + least))
                two = (pa.concat_arrays((pa.nulls(n, pa.int64()), pa.array(rolled(h, least, base)[at].view(np.int64)))) for h, base in zip(hashes, BASES))
                ids = b.column(1).take(pa.array(np.full(len(all_at), k, np.int32)))
                ends = pa.array([int(end[c["keep_at"] + least - 1]) if c["keep_row"] == row else None for c in chains] + [None] * len(at), pa.int64())
                keeps = (pa.array([c["keep_" + f] for c in chains] + [None] * len(at), t) for f, t in (("id", ids.type), ("row", pa.int64()), ("at", pa.int32())))
                cols = (ids, np.full(len(all_at), row, np.int64), all_at.astype(np.int32), all_last.astype(np.int32), start[all_at], end[all_last - 1], *two, *keeps, ends)
                yield pa.RecordBatch.from_pydict(dict(zip(("id", "row", "at", "last", "start", "end", "a", "b", "keep_id", "keep_row", "keep_at", "keep_end"), cols)))

    schema = f"id {kind}, row long, at int, last int, start long, end long, a long, b long, keep_id {kind}, keep_row long, keep_at int, keep_end long"
    return hits.select("row", "id", "text", "chains", "open").mapInArrow(run, schema)


def find_passages(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage to remove: id, word (number of the first), start, end, n_words, keep_id, keep_word (where its first window stays).

    ``docs`` is scanned twice and must give its rows in the same order (a change is an error).
    """
    within = min(WITHIN, max(least // 2, 1))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chained = staged(_chains(staged(_anchors(texts, least, within, kind)), least, within))
    kept = [F.col(f"keep.{x}").alias(f"keep_{x}") for x in ("id", "row", "at")]
    chains = chained.where(F.col("at") == F.col("low")).where(F.col("high") - F.col("low") >= least).select("row", F.struct("low", "high", *kept).alias("c"))
    at_end = (F.col("at") - within + 1 < F.col("low")) | (F.col("at") + least > F.col("high"))
    asked = chained.where(at_end)
    place = F.struct("gram", "at")
    opened = asked.select("row", place.alias("o")).unionByName(asked.select(F.col("keep.row").alias("row"), F.struct("gram", F.col("keep.at").alias("at")).alias("o")).distinct())
    both = chains.withColumn("o", F.lit(None).cast(opened.schema["o"].dataType)).unionByName(opened.withColumn("c", F.lit(None).cast(chains.schema["c"].dataType)))
    hits = both.groupBy("row").agg(F.collect_list("c").alias("chains"), F.collect_list("o").alias("open"))
    found = staged(_windows(texts.join(hits, "row"), least, within, kind))
    windows = found.where("a IS NOT NULL").drop("keep_id", "keep_row", "keep_at", "keep_end")
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "row", "at", "end")
    first = windows.groupBy("a", "b").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).where("n > 1")
    rest = join_groups(windows, first, ["a", "b"]).select("id", "row", "at", "last", "start", "end", *kept, F.col("keep.end").alias("keep_end"))
    rest = rest.where((F.col("row") != F.col("keep_row")) | (F.col("at") != F.col("keep_at"))).unionByName(found.where("a IS NULL").drop("a", "b"))
    inside = (F.col("row") == F.col("keep_row")) & (F.col("at") < F.col("keep_at") + least)
    rest = rest.withColumn("word", F.when(inside, F.col("keep_at") + least).otherwise(F.col("at"))).withColumn("start", F.when(inside, F.col("keep_end")).otherwise(F.col("start")))
    by_place = Window.partitionBy("row").orderBy("word", "at")
    apart = F.col("word") > F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    rest = rest.withColumn("passage", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by_place))
    head = F.min(F.struct("word", "start", "at", "keep_id", "keep_at"))
    spans = rest.groupBy("row", "passage").agg(F.first("id").alias("id"), head.alias("head"), F.max("end").alias("end"), F.max("last").alias("last"))
    return spans.select(
        F.col("id").alias(id_col), F.col("head.word").alias("word"), F.col("head.start").alias("start"), "end",
        (F.col("last") - F.col("head.word")).cast("long").alias("n_words"), F.col("head.keep_id").alias("keep_id"), F.col("head.keep_at").alias("keep_word"))
