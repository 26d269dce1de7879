"""Substring dedup by hashing of lines and of units below lines.

`find_units` is the whole operator. Its units are all lines with a word, of any length, and, wherever
lines begin and end, runs of 35 words that the words themselves choose (`content_cut`). Units are
normalised (words between white space, A-Z lower-cased) and hashed to 128 bits. Of all units
with one digest the earliest stays, by (id, row, place); the rest go, with their offsets in the
original text. Units that go and touch or overlap make one span, so short lines count together;
a span of fewer than ``least_words`` words stays where it is.

`find_repeats` is the plain form: lines (or paragraphs) of at least ``least_words`` words, one row each.

Texts are read once and not shuffled. The earliest unit is found with partial aggregation, so a
line that a third of all documents have costs a row per task; only units whose digest may occur
twice are shuffled behind that (`shared.split_likely`), and the largest groups meet by a broadcast of
few keys (`shared.join_groups`).

Defined results: a null text has no units; null ids rank last; repeated rows rank by their
order of reading, so one of them keeps the unit; an empty table gives no rows; further
columns pass through `remove_units` and `remove_repeats` untouched, and these tell rows apart by number.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saunter.llm.passages import find_passages
from saunter.llm.shared import Scratch, cut_spans, join_groups, likely, numbered_rows, staged
from saunter.llm.words import HashedWords, mixed, slices, spaced_words, utf8

LEAST_WORDS, PASSAGE_WORDS = 20, 50
#: Neighbouring runs of which one is a unit. Fewer: longer runs (so fewer short repeats go), and more of them.
WITHIN = 16
#: Odd numbers whose powers weight the words of a run.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def units(docs: DataFrame, least_words: int = LEAST_WORDS, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, unit, start, end, n_words, digest) of the units that are long enough; offsets in code points."""
    return _units(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), least_words, separator)


def _units(texts: DataFrame, least_words: int, separator: str) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()
    kinds = {"row": pa.int64(), "unit": pa.int32(), "start": pa.int64(), "end": pa.int64(), "n_words": pa.int64(), "digest": pa.string()}

    def run(batches):
        for b in slices(batches, "text"):
            at, cols = [], {k: [] for k in kinds}
            for i, (row, text) in enumerate(zip(b.column("row").to_pylist(), b.column("text").to_pylist())):
                start = 0
                for unit, part in enumerate((text or "").split(separator)):
                    words = spaced_words(part.encode())
                    if len(words) >= least_words:
                        at.append(i)
                        for k, v in zip(cols, (row, unit, start, start + len(part), len(words), hashlib.md5(b" ".join(words)).hexdigest())):
                            cols[k].append(v)
                    start += len(part) + len(separator)
            yield pa.RecordBatch.from_pydict({"id": b.column("id").take(pa.array(at, pa.int32())), **{k: pa.array(v, kinds[k]) for k, v in cols.items()}})

    schema = f"id {kind}, row long, unit int, start long, end long, n_words long, digest string"
    return texts.select("row", "id", "text").mapInArrow(run, schema)


def find_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit to remove: id, unit, start, end, n_words, digest, keep_id, keep_unit (where it stays)."""
    return _repeats(units(docs, least_words, separator, id_col, text_col)).drop("row").withColumnRenamed("id", id_col)


def _repeats(found: DataFrame) -> DataFrame:
    """The rows of `units` that go, and where each stays."""
    all_units = staged(found)
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "row", "unit")
    first = all_units.groupBy("digest").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).where("n > 1")
    rest = join_groups(all_units, staged(first), ["digest"]).where(~((F.col("row") == F.col("keep.row")) & (F.col("unit") == F.col("keep.unit"))))
    return rest.select("row", "id", "unit", "start", "end", "n_words", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.unit").alias("keep_unit"))


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    made = np.full((2, size + 1), 1, np.uint64)
    made[:, 1:] = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64)
    return tuple(np.cumprod(made, axis=1, dtype=np.uint64))


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run of words first to last: a polynomial in ``base`` from sums before places, with the run's length."""
    up, down = _powers(1 << max(16, len(hashes).bit_length()), base)
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[: len(hashes)], dtype=np.uint64)))
    return mixed((before[last] - before[first]) * up[last] ^ (last - first).astype(np.uint64))


def slid(x: np.ndarray, size: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of x[i : i + size] for each i, by doubled sizes."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out, have = least(out[: len(out) - step], out[step:]), have + step
    return out


def content_cut(words: HashedWords, least: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the units that the words themselves cut out, wherever lines begin and end.

    Of any ``within`` neighbouring runs of ``least - within + 1`` words the one with the smallest hash is a
    unit: so every ``least`` words in a row, in whatever text they stand, hold a unit that depends on them alone.
    """
    size, n = least - within + 1, len(words.hashes)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = run_hashes(words.hashes, np.arange(n - size + 1), np.arange(size, n + 1), BASES[0])
    smallest = slid(keys, within, np.minimum)
    text = np.searchsorted(words.firsts, np.arange(len(smallest)), side="right")
    smallest[np.arange(least, n + 1) > words.firsts[text]] = 0  # not inside one text
    held = slid(np.concatenate((np.zeros(within - 1, np.uint64), smallest, np.zeros(within - 1, np.uint64))), within, np.maximum)
    at = np.flatnonzero(held == keys)
    return at, at + size


def line_cut(words: HashedWords) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the lines that have words."""
    edges = np.searchsorted(words.starts, np.flatnonzero(words.data == 10))
    first, last = edges[:-1], edges[1:]
    return first[first < last], last[first < last]


def text_units(texts: DataFrame, least: int, within: int) -> DataFrame:
    """(id, row, at, last, start, end, a, b) of ``texts`` (row, id, text): both kinds of units with 128-bit digests; words and code points."""
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "row", "at", "last", "start", "end", "a", "b"]

    def run(batches):
        for b in slices(batches, "text"):
            words = HashedWords(utf8(b.column("text")))
            two, chars, out = (words.hashes, mixed(words.hashes ^ np.uint64(BASES[1]))), words.characters(), []
            for k, (first, last) in enumerate((line_cut(words), content_cut(words, least, within))):
                text = np.searchsorted(words.firsts, first, side="right") - 1
                origin = chars[words.begins[text]]
                digests = [run_hashes(h, first, last, base) ^ np.uint64(k) for h, base in zip(two, BASES)]
                out.append((text, first - words.firsts[text], last - words.firsts[text], chars[words.starts[first]] - origin, chars[words.ends[last - 1]] - origin, *(d.view(np.int64) for d in digests)))
            text, *cols = map(np.concatenate, zip(*out))
            kinds = (np.int32, np.int32, np.int64, np.int64, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(text)) for c in ("id", "row")), *(pa.array(c.astype(t)) for c, t in zip(cols, kinds))], names=names)

    return texts.select("row", "id", "text").mapInArrow(run, f"id {kind}, row long, at int, last int, start long, end long, a long, b long")


def _spans(texts: DataFrame, least: int, least_words: int) -> DataFrame:
    """(id, row, word, start, end, n_words, keep_id, keep_word) of `find_units`, for ``texts`` (row, id, text)."""
    stage = Scratch(texts.sparkSession)
    found = stage(text_units(texts, least, max(1, min(WITHIN, least // 2))))
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "row", "at", "end", "last")
    twice = stage(found.groupBy("a", "b").agg(F.min(rank).alias("keep"), F.count("*").alias("n")).where("n > 1"))
    rest = join_groups(stage(likely(found, twice, ["a", "b"])), twice, ["a", "b"]).where(~((F.col("row") == F.col("keep.row")) & (F.col("at") == F.col("keep.at"))))
    inside = (F.col("row") == F.col("keep.row")) & (F.col("at") < F.col("keep.last"))  # the words that stay are not cut
    rest = rest.select("id", "row", F.when(inside, F.col("keep.last")).otherwise(F.col("at")).alias("word"), F.when(inside, F.col("keep.end")).otherwise(F.col("start")).alias("start"),
                       "last", "end", F.col("keep.id").alias("keep_id"), F.col("keep.at").alias("keep_word"))
    order = Window.partitionBy("row").orderBy("word", "last")
    apart = F.col("word") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rest = rest.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    head = F.min(F.struct("word", "start", "last", "keep_id", "keep_word"))
    spans = rest.groupBy("row", "span").agg(F.first("id").alias("id"), head.alias("head"), F.max("last").alias("last"), F.max("end").alias("end"))
    found = spans.select("id", "row", F.col("head.word").alias("word"), F.col("head.start").alias("start"), "end", (F.col("last") - F.col("head.word")).cast("long").alias("n_words"),
                        F.col("head.keep_id").alias("keep_id"), F.col("head.keep_word").alias("keep_word"))
    return stage.result(found.where(F.col("n_words") >= least_words))


def find_units(docs: DataFrame, least: int = PASSAGE_WORDS, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span to remove: id, word (number of its first), start, end, n_words, keep_id, keep_word.

    Units are all lines with a word and, below lines, the runs that `content_cut` finds. Of the units
    with one digest the earliest stays, by (id, row, place). The others of a text that overlap or touch
    make a span; spans of fewer than ``least_words`` words stay: a short line on its own is not a passage.
    Of any ``least`` words that stand in an earlier place, at least one unit of ``least - WITHIN + 1`` goes.
    ``keep_id`` and ``keep_word`` say where the first unit of the span stays.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _spans(texts, least, least_words).drop("row").withColumnRenamed("id", id_col)


def _cut(numbered: DataFrame, row: str, found: DataFrame, text_col: str) -> DataFrame:
    """``numbered`` rows without the spans of ``found`` (row, start, end)."""
    spans = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("start_char"), F.col("end").alias("end_char")))).alias("spans"))
    return cut_spans(numbered, spans, row, text_col)


def remove_units(docs: DataFrame, least: int = PASSAGE_WORDS, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the spans of `find_units`. Rows are told apart by number: ids may repeat or be null."""
    numbered, row = numbered_rows(docs)
    texts = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _cut(numbered, row, _spans(texts, least, least_words), text_col)


def repeated_text(docs: DataFrame, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeat: kind, id, unit, start, end, n_words, digest, keep_id, keep_unit.

    A ``line`` with a word is a unit; a ``passage`` (see `passages`) has the number of its first word as
    unit and no digest. The two may overlap.
    """
    lines = find_repeats(docs, 1, separator, id_col, text_col).withColumn("kind", F.lit("line"))
    found = find_passages(docs, id_col=id_col, text_col=text_col).withColumnsRenamed({"word": "unit", "keep_word": "keep_unit"})
    return lines.unionByName(found.withColumns({"kind": F.lit("passage"), "digest": F.lit(None).cast("string")}))


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated units (and the separator behind each). Rows are told apart by number: ids may repeat or be null."""
    numbered, row = numbered_rows(docs)
    texts = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _repeats(_units(texts, least_words, separator))
    return _cut(numbered, row, found.withColumn("end", F.col("end") + len(separator)), text_col)
