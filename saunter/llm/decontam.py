"""Benchmark decontamination with an FM-index per training shard.

A partition's documents are gathered into shards of about ``SHARD_WORDS`` words; each is
indexed (`fm_index`), every window of every benchmark item is searched backwards, its
occurrences are located by sampled suffix positions, and covered words are merged into
removal spans. Documents never leave their partition: nothing is shuffled.

The benchmark goes through the driver block by block, about ``BLOCK_WORDS`` words at a time, and is
broadcast as blocks of item texts. A shard is indexed once and searched with each block in turn; only
one block's windows exist at a time. The stated bound of what is broadcast: the benchmark's text.

Defined results: a null text has no words; items without words have no windows; a null
item id is written "null"; repeated rows and null ids get a row each; an empty table gives
no rows, an empty benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.fm_index import FmIndex, ranges
from saunter.llm.shared import cut_spans, free_name, map_whole_rows, numbered_rows, staged
from saunter.llm.words import Numbers, alnum_words, released, slices, utf8

WINDOW = 10
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows_of(items: list[tuple[str, bytes]], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each distinct window with the items that have it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = alnum_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item)
    return found


class Shard:
    """Documents of a partition, until they are indexed and searched."""

    def __init__(self):
        self.numbers, self.docs, self.words = Numbers(), [], 0

    def add(self, text: bytes) -> None:
        ids = self.numbers.of(alnum_words(text))
        self.docs.append((ids, text))
        self.words += len(ids)

    def search(self, blocks, window: int):
        """For each document: text, words, covered words as a mask, items found."""
        n_docs, sizes = len(self.docs), np.array([len(ids) for ids, _ in self.docs])
        # Symbols: 0 ends the string, 1..n_docs end the documents, then the words.
        shift = n_docs + 1
        string = np.empty(sizes.sum() + n_docs + 1, np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        for d, (ids, _) in enumerate(self.docs):
            string[starts[d] : starts[d] + len(ids)] = ids + shift
            string[starts[d] + len(ids)] = d + 1
        string[-1] = 0
        covered, pairs = np.zeros(len(string) + 1, np.int32), set()
        index = FmIndex(string, shift + len(self.numbers))
        for block in blocks:
            by_length: dict[int, list] = {}
            for w, items in windows_of(block.value, window).items():
                if all(x in self.numbers for x in w):
                    by_length.setdefault(len(w), []).append(([self.numbers[x] + shift for x in w], items))
            for length, some in by_length.items():
                which, lo, hi = index.search(np.array([p for p, _ in some], np.int64))
                rows, of = ranges(lo, hi)
                at = index.locate(rows)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + length, -1)
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, k in set(zip(doc.tolist(), which[of].tolist())):
                    pairs.update((d, item) for item in some[k][1])
        mask, items = np.cumsum(covered) > 0, [[] for _ in range(n_docs)]
        for d, item in pairs:
            items[d].append(item)
        for d, (ids, text) in enumerate(self.docs):
            yield text, len(ids), mask[starts[d] : starts[d] + len(ids)], sorted(items[d])


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _shards(batches, text_col: str):
    """(shard, the record batches of its documents) until the partition ends."""
    shard, held = Shard(), []
    for b in slices(batches, text_col):
        first = 0
        for i, text in enumerate(utf8(b.column(text_col))):
            shard.add(text)
            if shard.words >= SHARD_WORDS:
                yield shard, [*held, b.slice(first, i + 1 - first)]
                shard, held, first = Shard(), [], i + 1
        if first < b.num_rows:
            held.append(b.slice(first))
    if shard.docs:
        yield shard, held
        released()


def _searched(docs: DataFrame, blocks: list, window: int) -> DataFrame:
    """For (row, id, text): row, id, n_words, n_hit, items, spans."""
    id_type = docs.schema["id"].dataType.simpleString()
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])

    def run(batches):
        for shard, held in _shards(batches, "text"):
            cols = [[], [], [], []]
            for text, n_words, mask, items in shard.search(blocks, window):
                spans = []
                if mask.any():
                    places = [m.span() for m in WORD.finditer(text.lower().decode())]
                    spans = [{"first": a, "end": b, "start_char": places[a][0], "end_char": places[b - 1][1]} for a, b in spans_of(mask)]
                for c, v in zip(cols, (n_words, int(mask.sum()), items, spans)):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span))
            made = [pa.array(c, k) for c, k in zip(cols, kinds)]
            row, ids = (pa.concat_arrays([b.column(c) for b in held]) for c in ("row", "id"))
            yield pa.RecordBatch.from_arrays([row, ids, *made], names=["row", "id", "n_words", "n_hit", "items", "spans"])

    spans = "array<struct<first: long, end: long, start_char: long, end_char: long>>"
    return docs.mapInArrow(run, f"row long, id {id_type}, n_words long, n_hit long, items array<string>, spans {spans}")


def _kept(docs: DataFrame, blocks: list, window: int, text_col: str) -> DataFrame:
    def run(batches):
        for shard, held in _shards(batches, text_col):
            clean = pa.array([not mask.any() for _, _, mask, _ in shard.search(blocks, window)], pa.bool_())
            yield from pa.Table.from_batches(held).filter(clean).to_batches()

    return map_whole_rows(docs, run, docs.schema)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int) -> list:
    """The benchmark's items (item, text) as broadcast blocks of about ``block_words`` words; the driver holds one block."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    made, some, size = [], [], 0
    for r in items.toLocalIterator():
        some.append((r["item"], r["text"].encode()))
        size += len(some[-1][1])
        if size >= 2 * block_words:  # a word takes two bytes at least
            made.append(benchmark.sparkSession.sparkContext.broadcast(some))
            some, size = [], 0
    return [*made, benchmark.sparkSession.sparkContext.broadcast(some)] if some else made


def _located(docs: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str, block_words: int) -> DataFrame:
    return _searched(docs, _blocks(benchmark, item_col, item_text_col, block_words), window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted strings), spans (words and code points, end exclusive)."""
    docs = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _located(docs, benchmark, window, item_col, item_text_col, block_words).drop("row").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns; nothing is shuffled."""
    return _kept(docs, _blocks(benchmark, item_col, item_text_col, block_words), window, text_col)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of `find_contamination`."""
    return found.select(found.columns[0], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of `find_contamination` cut out of the texts; an error if an id repeats (see `cut_contaminated`)."""
    if not found.groupBy(id_col).count().where("count > 1").isEmpty():
        raise ValueError(f"{id_col} repeats: spans found by id can't be told apart; use cut_contaminated")
    row = free_name(docs, "row_id")
    return cut_spans(docs.withColumn(row, F.col(id_col)), found.where("n_hit > 0").select(F.col(id_col).alias("row"), "spans"), row, text_col)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with every occurrence of a window cut out of the texts. Rows are told apart by number: ids may repeat or be null."""
    numbered, row = numbered_rows(docs)
    texts = numbered.select(F.col(row).alias("row"), F.lit(0).alias("id"), F.col(text_col).alias("text"))
    found = staged(_located(texts, benchmark, window, item_col, item_text_col, block_words).where("n_hit > 0").select("row", "spans"))
    return cut_spans(numbered, found, row, text_col)
