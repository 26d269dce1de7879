"""Helpers shared by the text operators: staging on shared storage and cleaned columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saunter.sources.folders import shared_dir, staged, written  # noqa: F401


class Scratch:
    """Tables staged during one call of an operator; they go when nothing reads them any more, or when its result is staged."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n, self.held = spark, shared_dir(spark), 0, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        out = staged(df, path := f"{self.base}/{self.n}")
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged ``tables`` that no plan still to run reads."""
        kept = []
        for out, path in self.held:
            if any(out is t for t in tables):
                discard(self.spark, path)
            else:
                kept.append((out, path))
        self.held = kept

    def result(self, df: DataFrame) -> DataFrame:
        out = staged(df)
        discard(self.spark, self.base)
        return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged path that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have: ``stem``, with underscores behind it if need be."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def columns_of(df: DataFrame, but: str | None = None) -> list[Column]:
    """The columns of ``df`` in order (``but`` one), whatever they are called: names may hold dots and spaces."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != but]


def map_whole_rows(docs: DataFrame, run, schema) -> DataFrame:
    """``docs.mapInArrow(run, schema)`` for rows of any columns: it can't be called where a name holds a dot, so columns travel by place."""
    names = docs.columns

    def renamed(batches):
        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(renamed, schema)


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row, and that column's name; staged, so a row keeps its number however often it is read."""
    name = free_name(docs, "row_number")
    return staged(docs.withColumn(name, F.monotonically_increasing_id())), name


#: Bits of the bitmap of `split_likely`: 8 MB, whatever the tables' sizes.
FILTER_BITS = 26


def split_likely(rows: DataFrame, keys: DataFrame, cols: list[str], bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``cols`` may be among those of ``keys``, and those that are surely not.

    Marks 2^bits slots, one for each hashed key, and broadcasts the marks: a bound that doesn't depend
    on the tables. What is surely not there needs no shuffle. The more keys, the more rows are in the first
    part by chance; a join behind tells them apart.
    """
    slot = lambda names: F.pmod(F.xxhash64(*names), F.lit(1 << bits)) + 1
    marks = keys.select(slot(cols).alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m"))
    place, bucket, mark = (free_name(rows, x) for x in ("mark_place", "mark_bucket", "marks"))
    placed = rows.withColumn(place, slot([F.col(c) for c in cols])).withColumn(bucket, F.expr(f"bitmap_bucket_number({place})")).withColumn(place, F.expr(f"bitmap_bit_position({place})"))
    near = placed.join(F.broadcast(marks.withColumnsRenamed({"b": bucket, "m": mark})), bucket, "left")
    set_ = F.expr(f"coalesce(getbit(cast(conv(hex(substring({mark}, int({place} div 8) + 1, 1)), 16, 10) as int), int({place} % 8)) = 1, false)")
    names = columns_of(rows)
    return near.where(set_).select(*names), near.where(~set_).select(*names)


def bits_for(keys: int) -> int:
    """Slots of `split_likely` for ``keys`` keys at most, as bits: 128 a key or more, between 2^16 and those of the full bitmap."""
    return min(FILTER_BITS, max(16, keys.bit_length() + 7))


def likely(rows: DataFrame, keys: DataFrame, cols: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The first part of `split_likely`."""
    return split_likely(rows, keys, cols, bits)[0]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Staged ``rows`` with what was found per key. Keys with over a thousandth of all rows (so under a thousand
    keys) are broadcast, the rest meets in a shuffle: no task gets a large group whole. Keys are not null."""
    limit = max(rows.count() // 1000, 1)
    large, slim = F.broadcast(groups.where(F.col(n) > limit)), groups.where(F.col(n) <= limit)
    rest = rows.join(large.select(*keys), keys, "left_anti").join(slim, keys)
    return rows.join(large, keys).unionByName(rest)


def text_of(col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def cut_spans(docs: DataFrame, found: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """``docs`` with spans cut out of the texts of ``found`` (row, spans: start_char, end_char; sorted, apart).

    ``row_col`` tells the rows of ``docs`` apart, as `numbered_rows` makes it; it goes in the end.
    """
    row, spans = free_name(docs, "cut_row"), free_name(docs, "cut_spans")
    hit = found.select(F.col("row").alias(row), F.col("spans").alias(spans))
    text, ends = F.col(text_col), F.transform(spans, lambda s: s["end_char"])
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
    kept = F.transform(spans, lambda s, i: F.substring(text, (before(i) + 1).cast("int"), (s["start_char"] - before(i)).cast("int")))
    cut = F.concat(F.array_join(kept, ""), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text)))
    joined = docs.join(hit, docs[row_col].eqNullSafe(F.col(row)), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNotNull(), cut).otherwise(text)).select(*columns_of(docs, row_col))
