"""Best-fit packing of token sequences by large-item matching.

Only the histogram of piece lengths decides how to pack: at most ``capacity`` counts, made
by Spark. `plan_bins` packs the histogram, many equal bins at a time:

1. Pieces above a third of the capacity go two to a bin at most: from the longest down,
   each is matched with the longest remaining one that fits beside it.
2. The smaller pieces, longest first, go where the remaining gap is smallest (best fit);
   a gap takes as many of them as fit. What is left opens new bins.

The plan has a number of rows that depends on the capacity, not on the corpus. Pieces get
their rank within their length from Spark (salted, so that a length that a third of all
pieces have is ranked by many tasks), and the plan maps (length, rank) to (bin, offset).

Defined results: a null or empty text is the end id alone; documents are told apart by
row, so repeated ids and null ids are packed as rows of their own; an empty table gives no
rows; only id and text are read.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saunter.llm.shared import staged
from saunter.llm.tokens import default_vocabulary, encoder
from saunter.llm.words import slices

CAPACITY = 4096
#: Pieces of one length that get a salt, at least, and salts that there are at most (and one for each length).
RANKED, MOST_SALTS = 64, 1 << 16


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids cut into pieces of ``capacity``: row, id, piece, start, length, ids_crc32[, ids]."""
    path, id_type = vocabulary or default_vocabulary(), docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        n = TaskContext.get().partitionId() << 40
        words = encoder(path)
        for b in slices(batches, 1, own=encoder):
            cols = {k: [] for k in ("row", "at", "piece", "start", "length", "ids_crc32", "ids")}
            for at, text in enumerate(b.column(1).to_pylist()):
                ids = words.encode(text)
                for p, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for k, v in zip(cols, (n, at, p, start, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        cols[k].append(v)
                n += 1
            at = pa.array(cols.pop("at"), pa.int32())
            kinds = dict(zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))
            out = {k: pa.array(v, kinds[k]) for k, v in cols.items() if with_ids or k != "ids"}
            yield pa.RecordBatch.from_pydict({"id": b.column(0).take(at), **out})

    schema = f"id {id_type}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


@dataclass
class Bins:
    """``count`` bins that hold the same runs (length, times), in this order."""

    count: int
    gap: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def split(self, count: int) -> Bins:
        self.count -= count
        return Bins(count, self.gap, list(self.runs))

    def add(self, length: int, times: int = 1) -> None:
        self.runs.append((length, times))
        self.gap -= length * times


def _match_large(left: dict[int, int], capacity: int) -> list[Bins]:
    made, large = [], sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        i -= i >= 0 and large[i] == a and left[a] == 1  # it can't be its own partner
        b = large[i] if i >= 0 else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        x = Bins(n, capacity)
        for k in (a, b):
            if k is not None:
                x.add(k)
                left[k] -= n
        made.append(x)
        large = [k for k in large if left[k]]
    return made


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for ``histogram[length]`` pieces of each length; equal bins stand together."""
    left = {k: n for k, n in histogram.items() if n > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a piece must be between 1 and the capacity long")
    made = _match_large(left, capacity)
    gaps: dict[int, list[Bins]] = {}
    order: list[int] = []

    def put(x: Bins) -> None:
        if x.gap not in gaps:
            bisect.insort(order, x.gap)
        gaps.setdefault(x.gap, []).append(x)

    for x in made:
        put(x)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                x = Bins(max(1, left[length] // (capacity // length)), capacity)
                made.append(x)
                put(x)
                continue
            gap = order[at]
            x = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            times = min(gap // length, left[length])
            bins = min(x.count, left[length] // times)
            if bins < x.count:
                rest, x = x, x.split(bins)
                put(rest)
                made.append(x)
            x.add(length, times)
            left[length] -= bins * times
            put(x)
    return made


def plan_rows(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, times, first bin, offset), sorted.

    The piece of rank r is number q = r - first rank of its row: it lies in bin
    first bin + q // times, at offset + (q % times) * length.
    """
    rows, rank, first = [], dict.fromkeys(histogram, 0), 0
    for x in plan_bins(histogram, capacity):
        offset = 0
        for length, times in x.runs:
            rows.append((length, rank[length], times, first, offset))
            rank[length] += x.count * times
            offset += length * times
        first += x.count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (staged, so that ranks stay as they are) with sequence_id and offset."""
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    each = max(RANKED, -(-sum(lengths.values()) // MOST_SALTS))
    salts = np.array([-(-lengths.get(k, 1) // each) for k in range(capacity + 1)])
    first = np.cumsum(salts) - salts  # where a length's salts stand in the list of all
    salt = F.pmod(F.xxhash64("row", "piece"), F.get(F.lit(salts.tolist()), F.col("length").cast("int")))
    salted = parts.withColumn("salt", (F.get(F.lit(first.tolist()), F.col("length").cast("int")) + salt).cast("long"))
    counts = np.zeros(salts.sum(), dtype=np.int64)
    for r in salted.groupBy("salt").agg(F.count("*").alias("n")).collect():  # a row per salt: MOST_SALTS + capacity at most
        counts[r["salt"]] = r["n"]
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[first], salts)
    plan = plan_rows(lengths, capacity)

    names = parts.columns

    def place(batches):
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            length, salt, nth = (b.column(k).to_numpy() for k in ("length", "salt", "nth"))
            rank = before[salt] + nth
            row = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            q = rank - row[:, 1]
            new = {"sequence_id": row[:, 3] + q // np.maximum(row[:, 2], 1), "offset": row[:, 4] + q % np.maximum(row[:, 2], 1) * length}
            kept = {k: b.column(k) for k in names}
            yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v, pa.int64()) for k, v in new.items()})

    nth = F.row_number().over(Window.partitionBy("salt").orderBy("row", "piece")).cast("long") - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return salted.withColumn("nth", nth).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    packed = pack(staged(pieces(docs, capacity, vocabulary, id_col, text_col, with_ids)), capacity)
    return packed.drop("row").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ids: sequence_id, length, ids (little-endian 32-bit).

    Only the columns sequence_id, offset, length and ids are read; no rows give no sequences.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # capacity pieces at most
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
