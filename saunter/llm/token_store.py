"""A content-addressed store of token ids.

`write_store` makes, below one path:

* ``chunks``: (chunk_id, n, ids): each distinct chunk once. A rolling hash over the last
  ``WINDOW`` ids cuts an id stream where its top bits are zero, so equal passages give equal
  chunks wherever they stand. ``chunk_id`` is the first 128 bits of sha256 of the ids;
  ids are little-endian, 16 bits wide if the vocabulary allows, else 32; the files are
  compressed with zstd.
* ``recipes``: (shard, doc_id, row, start, n_tokens, chunk_ids, root), in ascending doc_id
  order over the shards and within each; ``start`` counts the ids of all documents before.
* ``manifest``: (shard, docs, tokens, root): the Merkle root over the shard's document
  roots, each of which is the Merkle root over the document's chunk ids.

`read_back` reads the files, checks every chunk against its id and every root against
recipe and manifest, and gives each document's checksum by combining those of its chunks:
ids are not moved to documents. `reconstruct` gives the ids themselves. Both count first how
often a chunk is named: a chunk of many documents is broadcast (under a thousand chunks, of
16 KB at most), so no task gets all that name it.

Defined results: null text is empty (the end id alone); repeated and null ids are
documents of their own (nulls first); an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saunter.llm.shared import discard, join_groups, shared_dir, staged
from saunter.llm.tokens import default_vocabulary, encoder
from saunter.llm.words import slices

WINDOW, LEAST, MOST, CUT_BITS = 16, 64, 4096, 9
#: Text that is encoded together: the more, the fewer distinct words there are in all.
TOGETHER = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


INVERSE = pow(int(MULTIPLIER), -1, 1 << 64)


def rolling_marks(ids: np.ndarray) -> np.ndarray:
    """Positions behind which the hash of the last WINDOW ids has CUT_BITS zeros on top.

    The hash is a polynomial in an odd number modulo 2^64, made by doubling its length.
    """
    total = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    size, factor = 1, INVERSE
    while size < WINDOW:
        total[size:] = total[size:] + total[:-size] * np.uint64(factor)
        size, factor = 2 * size, factor * factor % (1 << 64)
    return np.flatnonzero(total * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - CUT_BITS) == 0) + 1


def cuts_of(ids: np.ndarray, ends: list[int]) -> tuple[list[int], list[int]]:
    """End positions of the chunks of several id streams that stand one behind another, and the stream of each.

    No chunk but a last one is below LEAST ids, which is above WINDOW: a mark that depends on
    the stream before is never used.
    """
    marks, found, of, k, last = [*rolling_marks(ids).tolist(), len(ids) + LEAST], [], [], 0, 0
    for stream, n in enumerate(ends):
        had = len(found)
        while last < n:
            while marks[k] - last < LEAST:
                k += 1
            m = min(marks[k], n, last + MOST)
            found.append(m)
            last = m
        of += [stream] * (len(found) - had)
    return found, of


def cuts(ids: np.ndarray) -> list[int]:
    """End positions of the chunks of an id stream."""
    return cuts_of(ids, [len(ids)])[0]


def merkle_root(leaves: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        level = [hashlib.sha256(b"\1" + x).digest() for x in pairs]
    return level[0]


def _encode(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per chunk of a document; the ids are there the first time a task meets the chunk."""
    id_type = docs.schema[id_col].dataType.simpleString()
    def chunked(batches):
        row, words, met = TaskContext.get().partitionId() << 40, encoder(vocabulary), set()
        for b in slices(batches, 1, TOGETHER, own=encoder):
            ids, ends = words.encode_all(b.column(1))
            found, of = cuts_of(ids, ends.tolist())
            raw, to = ids.astype(f"<u{width}").tobytes(), np.array(found, np.int64)
            parts = [raw[width * s : width * e] for s, e in zip([0, *found], found)]
            keys = [hashlib.sha256(x).digest()[:16] for x in parts]
            at = np.array(of, np.int32)
            seq = np.arange(len(of)) - np.searchsorted(at, at)
            new = []
            for key, part in zip(keys, parts):
                new.append(None if key in met else part)
                met.add(key)
            yield pa.RecordBatch.from_pydict({
                "id": b.column(0).take(pa.array(at)), "row": pa.array(row + at.astype(np.int64)), "seq": pa.array(seq.astype(np.int32)),
                "chunk_id": pa.array(keys, pa.binary()), "n": pa.array(np.diff(to, prepend=0).astype(np.int32)), "ids": pa.array(new, pa.binary())})
            row += b.num_rows

    return docs.select(id_col, text_col).mapInArrow(chunked, f"id {id_type}, row long, seq int, chunk_id binary, n int, ids binary")


def _roots(recipes: DataFrame, id_type: str) -> DataFrame:
    def rooted(batches):
        for b in batches:
            roots = [merkle_root(x) for x in b.column("chunk_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary())], names=[*b.schema.names, "root"])

    return recipes.mapInArrow(rooted, f"id {id_type}, row long, n_tokens long, chunk_ids array<binary>, root binary")


def _shard_roots(recipes: DataFrame) -> DataFrame:
    """A row per shard, from rows in file order. A shard is one file's rows: bounded by the range it covers."""
    ordered = recipes.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "row")

    def rooted(batches):
        shard, roots, tokens = None, [], 0
        for b in batches:
            for s, root, n in zip(*(b.column(k).to_pylist() for k in ("shard", "root", "n_tokens"))):
                if s != shard and roots:
                    yield shard, roots, tokens
                    roots, tokens = [], 0
                shard, tokens = s, tokens + n
                roots.append(root)
        if roots:
            yield shard, roots, tokens

    def rows(batches):
        for shard, roots, tokens in rooted(batches):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([len(roots)], pa.int64()),
                                              "tokens": pa.array([tokens], pa.int64()), "root": pa.array([merkle_root(roots)], pa.binary())})

    return ordered.select("shard", "doc_id", "row", "root", "n_tokens").mapInArrow(rows, "shard int, docs long, tokens long, root binary")


def write_store(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes ``docs`` into a new store and returns its path."""
    from tokenizers import Tokenizer

    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    path, rough = path or shared_dir(docs.sparkSession), shared_dir(docs.sparkSession)
    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = staged(_encode(docs, vocabulary, id_col, text_col, width), rough, compression="zstd")
    once = rows.where("ids is not null").groupBy("chunk_id").agg(F.first("n").alias("n"), F.first("ids").alias("ids"))
    once.write.option("compression", "zstd").parquet(f"{path}/chunks")

    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "n")))
    recipes = rows.groupBy("row").agg(F.first("id").alias("id"), parts.alias("parts"))
    recipes = recipes.select("id", "row", F.expr("aggregate(parts, 0L, (a, x) -> a + x.n)").alias("n_tokens"), F.col("parts.chunk_id").alias("chunk_ids"))
    recipes = staged(_roots(recipes, id_type))
    discard(spark, rough)
    shards = max(1, recipes.rdd.getNumPartitions())
    ordered = staged(recipes.repartitionByRange(shards, F.col("id").asc_nulls_first(), "row").withColumn("shard", F.spark_partition_id()))
    totals = ordered.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per shard
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard").orderBy(F.col("id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offsets, "shard")
    placed = placed.select("shard", F.col("id").alias("doc_id"), "row", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "chunk_ids", "root")
    placed.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "row").write.parquet(f"{path}/recipes")
    _shard_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    return path


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = np.zeros_like(a)
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


@lru_cache(maxsize=None)
def _byte_powers() -> list[np.ndarray]:
    """x to the power 8 * 2^k, modulo the polynomial, for each k."""
    found = [np.array([1 << 23], np.uint32)]
    for _ in range(47):
        found.append(_times(found[-1], found[-1]))
    return found


def combine(crcs: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """crc32 of concatenations: of the parts from each of ``firsts`` to before the next, with their bytes in ``sizes``.

    A part's checksum counts times x^8 for each byte behind it, and the products are added.
    """
    ends = np.cumsum(sizes)
    behind = np.repeat(np.append(ends[firsts[1:] - 1], ends[-1:]), np.diff(np.append(firsts, len(sizes)))) - ends
    power = np.full(len(sizes), 1 << 31, np.uint32)
    for k in range(int(behind.max(initial=0)).bit_length()):
        power = np.where(behind >> k & 1, _times(power, np.broadcast_to(_byte_powers()[k], power.shape)), power)
    return np.bitwise_xor.reduceat(_times(power, crcs.astype(np.uint32)), firsts)


def widened(ids: bytes, n: int) -> bytes:
    """Ids of either width in 32 bits; nothing for a chunk that is damaged in its length."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else b""


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, n, crc, sound): what the chunk files hold; crc over 32-bit ids."""
    def checked(batches):
        for b in batches:
            keys, ns, ids = (b.column(k).to_pylist() for k in ("chunk_id", "n", "ids"))
            sound = [hashlib.sha256(x).digest()[:16] == k and len(x) in (2 * n, 4 * n) for k, n, x in zip(keys, ns, ids)]
            crc = [zlib.crc32(widened(x, n)) for n, x in zip(ns, ids)]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("n"), pa.array(crc, pa.int64()), pa.array(sound, pa.bool_())], names=["chunk_id", "n", "crc", "sound"])

    return spark.read.parquet(f"{path}/chunks").select("chunk_id", "n", "ids").mapInArrow(checked, "chunk_id binary, n int, crc long, sound boolean")


def _asked(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """What is known of each chunk that recipes name, nulls if it is lost, and how many ``refs`` name it: a row per chunk."""
    return refs.groupBy("chunk_id").agg(F.count("*").alias("refs")).join(chunks, "chunk_id", "left")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, verified."""
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest").alias("m")
    again = _shard_roots(recipes).alias("a")
    shards = again.join(manifest, "shard", "left").select("shard", F.coalesce(F.expr("a.root = m.root and a.docs = m.docs and a.tokens = m.tokens"), F.lit(False)).alias("shard_ok"))
    refs = recipes.select("row", F.posexplode("chunk_ids").alias("seq", "chunk_id"))
    known = join_groups(refs, staged(_asked(refs, read_chunks(spark, path))), ["chunk_id"], "refs")
    parts = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "sound"))).alias("parts"))
    rows = recipes.join(parts, "row").join(shards, "shard")
    id_type = recipes.schema["doc_id"].dataType.simpleString()

    def summed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column("parts")
            flat, firsts = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
            n, crc, sound = (np.nan_to_num(pc.cast(flat.field(k), pa.float64()).to_numpy(zero_copy_only=False)).astype(np.int64) for k in ("n", "crc", "sound"))
            whole, sizes = np.minimum.reduceat(sound, firsts) > 0, np.add.reduceat(n, firsts)
            rooted = [merkle_root(keys) == root for keys, root in zip(b.column("chunk_ids").to_pylist(), b.column("root").to_pylist())]
            fine = whole & np.array(rooted) & (sizes == b.column("n_tokens").to_numpy()) & b.column("shard_ok").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(combine(crc, 4 * n, firsts).astype(np.int64), mask=~whole), pa.array(fine)],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    wanted = rows.select("doc_id", "start", "n_tokens", "parts", "root", "chunk_ids", "shard_ok")
    return wanted.mapInArrow(summed, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, verified boolean")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids): every document's ids again (32 bits wide), from recipes and chunks; null if one of its chunks is lost."""
    def wide(batches):
        for b in batches:
            keys, ns, ids = (b.column(k).to_pylist() for k in ("chunk_id", "n", "ids"))
            yield pa.RecordBatch.from_pydict({"chunk_id": pa.array(keys, pa.binary()), "ids": pa.array([widened(x, n) for x, n in zip(ids, ns)], pa.binary())})

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(wide, "chunk_id binary, ids binary")
    refs = spark.read.parquet(f"{path}/recipes").select("doc_id", "row", F.posexplode("chunk_ids").alias("seq", "chunk_id"))
    parts = join_groups(refs, _asked(refs, chunks), ["chunk_id"], "refs").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    return parts.select("doc_id", "row", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
