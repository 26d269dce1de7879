"""Near duplicates: an exact Jaccard join on word shingles with count-vector R-trees.

1. One pass hashes each document's distinct shingles. Documents with one shingle set are
   one class. The pass also counts, over all documents, how many shingles fall into each of
   ``CELLS`` hash cells: a measure of how common a shingle is. Shingles are also hashed into
   groups, and a class's group counts are its point: the sum of coordinate minima bounds what
   two sets, or two tree nodes, can share.
2. Two sets of similarity t share an element among the first n - ceil(t n) + 1 of each, in
   any common order; the order here is rare cells first, so passages and lines that very
   many documents have are not met on. Classes that meet are linked to the least class
   of the meeting: the *leader*. A leader and all that it led form a group; every
   similar pair has a group in common. An element of a rare cell is met on in a shuffle that
   streams by; one of a cell far above the mean goes by counts and leaders made before the
   shuffle, and the few largest by a broadcast of their leaders.
3. Each class is compared with those of its leaders that the bound leaves. That joins groups
   of near copies, of whatever size, in one step, so what they connect needs no search.
4. The members of groups that still hold several components are the leaves of R-trees, ``BLOCK``
   a block, ordered by component and size. The blocks' boxes make the trees' upper levels: a
   search of these says which pairs of blocks can hold a similar pair of different
   components; only these meet, in a tree of points each. Classes with a possible partner
   get their sets, and the surviving pairs are verified on these; a pair that
   verified links already connect is not needed for the components.

Defined results: a text without words has an empty set and is linked with nothing; repeated
rows and equal texts are of one class; a null id takes part, but never is a component's id
while there is another; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.graph import components
from saunter.llm.rtree import LEAST_GROUPS, RTree, candidate_pairs, folded, group_counts
from saunter.llm.shared import Scratch, bits_for, columns_of, free_name, join_groups, likely, split_likely, text_of
from saunter.llm.words import HashedWords, mixed, slices, utf8

SHINGLE, PERCENT = 5, 75
CELL_BITS = 18
#: Members of a block, and bytes of their sets after which it ends before.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Times the mean count of a cell that is used, above which its elements are dealt out by their counts.
FAR_ABOVE = 8
#: What a step puts into the shuffle at once: so many elements, members or rows with whole sets; larger tables go in slices, MOST_SLICES at most.
SLICE_ELEMENTS, SLICE_MEMBERS, SLICE_SETS, MOST_SLICES = 1 << 24, 1 << 18, 1 << 14, 8
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: HashedWords, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than ``size`` words, the whole sequence is one."""
    def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
        total = np.full(max(0, len(hashes) - width + 1), np.uint64(width))
        for k in range(width):
            total = total * STEP + hashes[k : len(hashes) - width + 1 + k]
        return mixed(total)

    whole, found = rolled(words.hashes, size), []
    for a, z in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        if z - a < size:
            found.append(rolled(words.hashes[a:z], z - a) if z > a else words.hashes[:0])
            continue
        s = np.sort(whole[a : z - size + 1])
        found.append(s[np.append(True, s[1:] != s[:-1])])
    return found


def signature(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def low_half(sig: bytes) -> int:
    return int.from_bytes(sig[8:], "big", signed=True)


def _sets(batches, size: int):
    """Runs of rows (id, text) with the set of each."""
    for b in slices(batches, 1):
        yield b, shingle_sets(HashedWords(utf8(b.column(1))), size)


def _profile(docs: DataFrame, size: int, id_type: str) -> DataFrame:
    """Rows (row, id, n, sig, point) per document; at a task's end rows (cell, count)."""
    names = ["row", "id", "n", "sig", "point", "cell", "count"]

    def run(batches):
        cells, n, kind = np.zeros(1 << CELL_BITS, np.int64), TaskContext.get().partitionId() << 40, None
        for b, sets in _sets(batches, size):
            kind, m = b.column(0).type, len(sets)
            held = (np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            cells += np.bincount(held, minlength=1 << CELL_BITS)
            cols = [pa.array(np.arange(n, n + m)), b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()),
                    pa.array([packed(group_counts(s)) for s in sets], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())]
            n += m
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if kind is not None:
            used = np.flatnonzero(cells)
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(used, pa.int32()), pa.array(cells[used])], names=names)

    return docs.mapInArrow(run, f"row long, id {id_type}, n long, sig binary, point binary, cell int, count long")


def _common(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the order of magnitude of its count, and whether it is far above the mean: 2^CELL_BITS values, however large the corpus."""
    found = profile.where("cell is not null").groupBy("cell").agg(F.sum("count").alias("n")).toArrow()
    counts = np.zeros(1 << CELL_BITS)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(63, np.log2(np.maximum(counts, 1))).astype(np.uint64), counts > FAR_ABOVE * counts[counts > 0].mean() if len(found) else counts > 0


def _met(docs: DataFrame, common, size: int, percent: int) -> DataFrame:
    """(h, lo, far): the elements of each class's prefix, with half the class's signature and whether the element's cell is far above the mean.

    Classes that share a half are all meant by it: that adds candidates. Only two similar classes that
    share one (one pair in 2^64) would not be each other's.
    """
    def keys(batches):
        (order, far), met = common.value, set()
        for _, sets in _sets(batches, size):
            hs, los = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in sets:
                if not len(s) or (sig := signature(s)) in met:
                    continue
                met.add(sig)
                first = len(s) - -(-percent * len(s) // 100) + 1
                ranked = order[s >> np.uint64(64 - CELL_BITS)] << np.uint64(58) | s >> np.uint64(6)
                hs.append(np.partition(ranked, first - 1)[:first] if first < len(s) else ranked)
                los.append(np.full(len(hs[-1]), low_half(sig)))
            h = np.concatenate(hs)
            cell = h << np.uint64(6) >> np.uint64(64 - CELL_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(los)), pa.array(far[cell])], names=["h", "lo", "far"])

    return docs.mapInArrow(keys, "h long, lo long, far boolean")


def _sliced(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``rows`` (staged) in slices of some ``most`` rows by their ``key``, one after another: a slice's shuffle and what its sorts spill are gone before the next."""
    n = max(1, min(MOST_SLICES, -(-rows.count() // most)))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)] if n > 1 else [rows]


def _united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _meetings(met: DataFrame, stage: Scratch) -> DataFrame:
    """Distinct (lead, lo): two classes with an element of their prefixes in common."""
    def led(batches):
        last_h, last_lead = None, None
        for b in batches:
            h, lo = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(h):
                continue
            first = np.concatenate([[last_h is None or h[0] != last_h], h[1:] != h[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
            lead = np.where(at >= 0, lo[np.maximum(at, 0)], last_lead if last_lead is not None else 0)
            last_h, last_lead = h[-1], lead[-1]
            pairs = np.unique(np.stack([lead, lo], axis=1)[lead != lo], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["lead", "lo"])

    # Sorted, a key's rows stream by: its first class is the leader, and no group is held.
    near = _united([stage(some.where("not far").select("h", "lo").repartition("h").sortWithinPartitions("h", "lo").mapInArrow(led, "lead long, lo long").distinct())
                    for some in _sliced(met, "h", SLICE_ELEMENTS)])
    far = met.where("far").select("h", "lo")
    leads = stage(far.groupBy("h").agg(F.min("lo").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    return near.unionByName(join_groups(far, leads, ["h"]).where("lead <> lo").select("lead", "lo")).distinct()


def packed(point: np.ndarray) -> bytes:
    return b"%d" % point.itemsize + point.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], dtype=np.uint8 if raw[:1] == b"1" else np.uint32)


def _set_table(docs: DataFrame, wanted: DataFrame, most: int, size: int) -> DataFrame:
    """(sig, set) of the wanted classes, ``most`` at most (and of few others, by chance): the texts of their first documents are read again, and not shuffled."""
    some = likely(docs, wanted.select(F.col("min_id").alias("id")), ["id"], bits_for(most))

    def run(batches):
        for _, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "set"])

    return some.select("id", "text").mapInArrow(run, "sig binary, set binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |A and B| >= percent |A or B|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _paired(pairs: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the table's columns of either side, as <col>_a and <col>_b."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("sig").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
    return pairs


def _possible_stars(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and points leave possible."""
    def run(batches):
        for b in batches:
            x, y = ([unpacked(v) for v in b.column(k).to_pylist()] for k in ("point_a", "point_b"))
            n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            shared = np.array([np.minimum(*folded([p, q])).sum() for p, q in zip(x, y)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array((100 + percent) * shared >= percent * n))

    sized = _paired(stars, classes, ["n", "point"]).where(F.expr(f"100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a"))
    return sized.select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(run, "a binary, b binary")


def _star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for b in slices(batches, "set_a"):
            x, y = (b.column(k).to_pylist() for k in ("set_a", "set_b"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(
                [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)], pa.bool_()))

    return _paired(stars, sets, ["set"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _numbered_blocks(members: DataFrame, part: int = 0) -> DataFrame:
    """``members`` (of a slice of leads, the ``part``-th) with their block, in the order (lead, comp, n); and a row with a box for each block of a lead that may have several.

    A box is (largest coordinates in the fewest groups, size and component ranges, members, bytes of their sets). A lead that begins
    and ends inside a task and fills no block is ``alone`` in its block and needs no box; with one component, no row.
    """
    data = ["sig", "comp", "n", "point"]
    names = ["lead", "block", *data, "box", "most", "last", "members", "held", "alone"]

    def box(lead, rows, block):
        _, comps, sizes, points = zip(*rows)
        most = folded([*map(unpacked, points), np.zeros(LEAST_GROUPS, np.uint8)]).max(axis=0).astype(np.uint32)
        return lead, block, None, min(comps), min(sizes), None, most.tobytes(), max(sizes), max(comps), len(rows), 8 * sum(sizes), False

    def run(batches):
        block, lead, rows, held, out = part << 52 | TaskContext.get().partitionId() << 32, None, [], 0, []
        begun, edge = block, True  # the lead's first block here; whether the lead may have begun in the task before

        def close(whole: bool):
            """Ends a block; ``whole`` if its lead has no more members anywhere behind it."""
            nonlocal block, rows, held
            alone = whole and not edge and block == begun
            if not alone or rows[0][1] != rows[-1][1]:
                out.extend((lead, block, *r, None, None, None, None, None, alone) for r in rows)
            if not alone:
                out.append(box(lead, rows, block))
            block, rows, held = block + 1, [], 0

        def made():
            return pa.RecordBatch.from_pydict({k: pa.array(c, kinds[k]) for k, c in zip(names, zip(*out))})

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in ("lead", *data))):
                if r[0] != lead:
                    if rows:
                        close(True)
                        edge = False
                    lead, begun = r[0], block
                size = 8 * r[3]  # of the set, which is not here
                if len(rows) >= BLOCK or rows and held + size > BLOCK_BYTES:
                    close(False)
                rows.append(r[1:])
                held += size
            if out:
                yield made()
                out.clear()
        if rows:
            close(False)
        if out:
            yield made()

    kinds = {k: pa.binary() for k in names} | dict.fromkeys(("block", "n", "most", "members", "held"), pa.int64()) | {"alone": pa.bool_()}
    ddl = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    order = ["lead", "comp", "n", "sig"]
    return members.select("lead", *data).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"{k} {ddl[kinds[k]]}" for k in names))


def _joined_boxes(rows: list[tuple]) -> list[list[tuple]]:
    """The boxes of a lead, in order, with those side by side that fit into one block taken together."""
    found, members, held = [], BLOCK, 0
    for r in rows:
        if members + r[-2] > BLOCK or held + r[-1] > BLOCK_BYTES:
            found.append([])
            members = held = 0
        found[-1].append(r)
        members, held = members + r[-2], held + r[-1]
    return found


def _block_pairs(boxes: DataFrame, percent: int) -> DataFrame:
    """(block, own, i, j): the pairs of a lead's blocks, a block with itself too, that can hold a similar pair of different components.

    A search of the trees' upper levels, whose leaves are the boxes. Blocks that tasks cut short are joined: ``own`` is the
    joined block that a block belongs to, i or j.
    """
    def found(rows: list[tuple]):
        parts = _joined_boxes(rows)
        cols = [list(zip(*part)) for part in parts]
        points = np.stack([np.max([np.frombuffer(p, np.uint32).astype(np.int32) for p in c[1]], axis=0) for c in cols])
        least, most, first, last = (np.array([f(c[k]) for c in cols]) for k, f in ((2, min), (3, max), (4, min), (5, max)))
        number = {c: k for k, c in enumerate(sorted({*first.tolist(), *last.tolist()}))}
        a, z = (np.array([number[c] for c in x.tolist()]) for x in (first, last))
        pairs = [(x, x) for x in np.flatnonzero(a != z).tolist()]
        for x, y in RTree(points, least, a, most, z).similar_pairs(percent):
            pairs += zip(x.tolist(), y.tolist())
        for x, y in pairs:
            i, j = sorted((cols[x][0][0], cols[y][0][0]))
            for k in {x, y}:
                yield from ((block, cols[k][0][0], i, j) for block in cols[k][0])

    def made(pairs):
        return pa.RecordBatch.from_pydict({k: pa.array([p[n] for p in pairs], pa.int64()) for n, k in enumerate(("block", "own", "i", "j"))})

    def run(batches):
        lead, rows = None, []
        for b in batches:
            pairs = []
            for r in zip(*(b.column(k).to_pylist() for k in ("lead", "block", "box", "n", "most", "comp", "last", "members", "held"))):
                if r[0] != lead and rows:
                    pairs += found(rows)
                    rows = []
                lead = r[0]
                rows.append(r[1:])
            yield made(pairs)
        if rows:
            yield made(list(found(rows)))

    some = boxes.select("lead", "block", "box", "n", "most", "comp", "last", "members", "held")
    return some.repartition("lead").sortWithinPartitions("lead", "block").mapInArrow(run, "block long, own long, i long, j long")


def _dealt(both: DataFrame, percent: int) -> DataFrame:
    """Members (sig, comp, ...) of groups with several components, in those pairs (i, j) of blocks that the boxes leave. ``both`` are those of `_numbered_blocks`, staged."""
    rows = both.where("box is null").select("block", "sig", "comp", "n", "point", "alone")
    pairs = _block_pairs(both.where("box is not null"), percent)
    alone = rows.where("alone").drop("alone").withColumns({"i": F.col("block"), "j": F.col("block")})
    return alone.unionByName(rows.where("not alone").drop("alone").join(pairs, "block").drop("block").withColumnRenamed("own", "block"))


def _solved(groups: DataFrame, names: list[str], solve, schema: str) -> DataFrame:
    """``solve`` on the rows of each (i, j), sorted by these; there are two blocks at most. It gives rows of ``schema``."""
    out = {c.split()[0]: pa.int64() if c.endswith("long") else pa.binary() for c in schema.split(", ")}

    def made(found: list[tuple]):
        return pa.RecordBatch.from_pydict({k: pa.array([f[n] for f in found], t) for n, (k, t) in enumerate(out.items())})

    def run(batches):
        key, rows = None, []
        for b in batches:
            found = []
            for r in zip(*(b.column(k).to_pylist() for k in ("i", "j", *names))):
                if r[:2] != key:
                    found += solve(rows)
                    key, rows = r[:2], []
                rows.append(r)
            yield made(found)
        yield made(solve(rows))

    return groups.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, schema)


def _possible_pairs(blocks: list[int], points: list[bytes], sizes: list[int], comps: list[bytes], percent: int):
    """Candidates of a tree of points; of two blocks, those with an end in each."""
    number, own = {c: i for i, c in enumerate(sorted(set(comps)))}, np.array(blocks)
    for a, b in candidate_pairs([unpacked(p) for p in points], np.array(sizes), np.array([number[c] for c in comps]), percent):
        across = own[a] != own[b] if own.min() != own.max() else np.ones(len(a), bool)
        yield a[across], b[across]


MEMBER = "i long, j long, block long, sig binary, comp binary, n long, point binary"


def _with_partner(groups: DataFrame, percent: int) -> DataFrame:
    """The members that have a possible partner in another component of their pair of blocks."""
    def solve(rows: list[tuple]) -> list[tuple]:
        if len({r[4] for r in rows}) < 2:
            return []
        _, _, blocks, _, comps, sizes, points = zip(*rows)
        found: set[int] = set()
        for a, b in _possible_pairs(blocks, points, sizes, comps, percent):
            found.update(a.tolist(), b.tolist())
        return [rows[k] for k in sorted(found)]

    return _solved(groups, ["block", "sig", "comp", "n", "point"], solve, MEMBER)


def _group_links(groups: DataFrame, percent: int) -> DataFrame:
    """Verified links between components inside each group; of those that connect the same components one is enough."""
    def solve(rows: list[tuple]) -> list[tuple]:
        if len({r[4] for r in rows}) < 2:
            return []
        _, _, blocks, sigs, comps, sizes, points, raw = zip(*rows)
        sets, up, found = [np.frombuffer(x, np.uint64) for x in raw], {c: c for c in comps}, []

        def top(x: bytes) -> bytes:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in _possible_pairs(blocks, points, sizes, comps, percent):
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = top(comps[i]), top(comps[j])
                if x != y and similar(sets[i], sets[j], percent):
                    up[x] = y
                    found.append((sigs[i], sigs[j]))
        return found

    return _solved(groups, ["block", "sig", "comp", "n", "point", "set"], solve, "a binary, b binary")


def _rest_links(stars: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, slim: DataFrame, size: int, percent: int, stage: Scratch) -> DataFrame:
    """Links inside the groups that the leaders have not joined."""
    members, found = stage(stars.select(F.col("a").alias("lead"), F.col("b").alias("sig")).union(stars.select("a", "a")).distinct()), []
    for part, own in enumerate(_sliced(members, "lead", SLICE_MEMBERS)):
        named = own.join(comps.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        named = stage(named.join(classes.select("sig", "n", "point"), "sig"))
        both = stage(_numbered_blocks(named, part))
        stage.drop(named)
        found.append(stage(_with_partner(_dealt(both, percent), percent)))
        stage.drop(both)
    stage.drop(members)
    some = _united(found)
    missing = stage(classes.join(some.select("sig").distinct(), "sig", "left_semi").join(sets, "sig", "left_anti").select("sig", "min_id"))
    if n := missing.count():
        sets = sets.unionByName(stage(_set_table(slim, missing, n, size)))
    return _united([stage(_group_links(own.join(sets.join(own.select("sig").distinct(), "sig", "left_semi"), "sig"), percent)) for own in _sliced(some, "i", SLICE_SETS)])


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links)."""
    return _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _components(slim: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n_shingles, component_id) of (id, text)."""
    spark, stage = slim.sparkSession, Scratch(slim.sparkSession)
    profile = stage(_profile(slim, size, slim.schema["id"].dataType.simpleString()))
    rows = profile.where("cell is null").select("id", "n", "sig", "point")
    classes = stage(classes_of(rows))
    low = classes.select("sig", F.expr("conv(hex(substring(sig, 9, 8)), 16, -10)").cast("long").alias("lo"))

    elements = stage(_met(slim, spark.sparkContext.broadcast(_common(profile)), size, percent))
    met = _meetings(elements, stage)
    stars = met.join(low.select("lo", F.col("sig").alias("b")), "lo").join(low.select(F.col("lo").alias("lead"), F.col("sig").alias("a")), "lead")
    stars = stage(stars.select("a", "b").where("a <> b"))
    stage.drop(elements)
    return joined_classes(slim, rows, classes, stars, size, percent, stage)


def classes_of(rows: DataFrame, *more: str) -> DataFrame:
    """A row per distinct set: its smallest id, size, point and copies; and further columns that depend on the set alone."""
    return rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("min_id"), F.first("n").alias("n"), F.first("point").alias("point"), *(F.first(c).alias(c) for c in more), F.count("*").alias("copies"))


def joined_classes(slim: DataFrame, rows: DataFrame, classes: DataFrame, stars: DataFrame, size: int, percent: int, stage: Scratch) -> DataFrame:
    """(id, n_shingles, component_id): what candidate ``stars`` (a leader and a class it led) and the groups of a leader hold, verified on whole sets."""
    near = stage(_possible_stars(stars, classes, percent))
    wanted = classes.join(near.select(F.col("a").alias("sig")).union(near.select("b")).distinct(), "sig", "left_semi")
    sets = stage(_set_table(slim, wanted, 2 * near.count(), size))

    comps = components(_star_links(near, sets, percent), stage)
    more = _rest_links(stars, comps, classes, sets, slim, size, percent, stage)
    stage.drop(sets, near)
    if not more.isEmpty():
        comps = components(comps.select(F.col("v").alias("a"), F.col("comp").alias("b")).union(more), stage)

    named = stage(classes.select("sig", "min_id", "copies").join(comps.withColumnRenamed("v", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig")))
    least = stage(named.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.count("*").alias("n")))
    ids = stage(join_groups(named, least, ["comp"]).select("sig", "component_id", "copies"))
    full = rows.where("n > 0").select("id", "n", "sig")
    found = join_groups(full, ids, ["sig"], "copies").select("id", F.col("n").alias("n_shingles"), "component_id")
    bare = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return stage.result(found.unionByName(bare))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id, of equal ids the smallest digest of the text.

    Rows are told apart by id and text, so ids may repeat: only the near copy goes, not another row of its id. Null ids
    come after all others. Of rows that repeat an id and a text with words one stays. Rows that stay are not shuffled (but
    few, by chance of the bitmap).
    """
    digest, late = F.unhex(F.md5(text_of(text_col))), F.col(id_col).isNull()
    key = F.struct(late.alias("late"), F.col(id_col).alias("id"), digest.alias("digest"))
    found = _components(docs.select(key.alias("id"), F.col(text_col).alias("text")), size, percent)
    name, mark = free_name(docs, "near_id"), free_name(docs, "near_digest")
    told = [F.col("id.id").alias(name), F.col("id.digest").alias(mark)]
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(*told).distinct()
    again = found.where("n_shingles > 0").groupBy("id").count().where("count > 1").select(*told)
    own = free_name(docs, "near_own")
    some, rest = split_likely(docs.withColumns({own: digest, name: F.col(id_col)}), gone.unionByName(again).withColumnRenamed(mark, own), [name, own], bits_for(found.count()))
    same = F.expr(f"s.`{name}` <=> g.`{name}` and s.`{own}` = g.`{mark}`")
    stay = some.alias("s").join(gone.alias("g"), same, "left_anti")
    single = stay.alias("s").join(again.alias("g"), same, "left_anti")
    repeated = stay.alias("s").join(again.alias("g"), same, "left_semi").dropDuplicates([name, own])
    return rest.unionByName(single).unionByName(repeated).select(*columns_of(docs))
