"""The trie of conversations' prefixes, with totals of every subtree.

1. Turns are put in order by ranges, not by conversation (`ordered_turns`): a conversation with a third of all
   turns is sorted by several tasks. Only digests and lengths move, texts only where turns of a conversation tie.
2. A prefix is told by its length and by two 64-bit sums (exclusive or) of hashes of (turn, place). Such sums are made in
   chunks of a conversation's turns.
3. Prefixes are grouped by partial aggregation: the members of a node are counted, never listed. Nodes get numbers,
   children find their parents by `join_groups`.
4. Totals of subtrees come from tree contraction (`contraction`).
5. The conversations that end at a node are sorted by ranges and joined to pieces of text in several tasks; one pass over a node's
   pieces makes its digest, in bounded memory.

Defined results: rows without a conv_id belong to no conversation; null turns come first, and equal turns go by role and
text; null roles and texts are empty; repeated rows are turns each; an empty table gives no nodes; further columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saunter.llm.contraction import subtree_sums
from saunter.llm.shared import Scratch, join_groups, split_likely, text_of

#: Turns of a conversation that one window holds.
CHUNK = 4096
#: Bytes of a node's member list that are handed on as one row.
PIECE = 1 << 16
KEY = ["depth", "a", "b"]


def ordered_turns(conversations: DataFrame, stage: Scratch) -> DataFrame:
    """Staged (conv_id, part, nth, digest, n_chars): each turn's place within its conversation is that of its ``part`` (see `parts`) and nth."""
    role, text = text_of("role"), text_of("text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ties = rows.groupBy("conv_id", "turn").count().where("count > 1")
    some, rest = split_likely(rows, ties, ["conv_id", "turn"])
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text"))))
    told = lambda df, tie: df.select("conv_id", "turn", tie.alias("tie"), digest.alias("digest"), F.length("text").cast("long").alias("n_chars"))
    both = told(some, F.struct("role", "text")).unionByName(told(rest, F.lit(None).cast("struct<role:string,text:string>")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nth", F.monotonically_increasing_id())
    return stage(placed.select("conv_id", F.shiftright("nth", 33).alias("part"), "nth", "digest", "n_chars"))


def parts(turns: DataFrame) -> DataFrame:
    """(conv_id, part, first, n, before, n_turns): a conversation's turns in each range, how many come before them and how many it has."""
    own = Window.partitionBy("conv_id")
    counted = turns.groupBy("conv_id", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumns({"before": before, "n_turns": F.sum("n").over(own)})


def with_shared_heads(turns: DataFrame, stage: Scratch, template: Column, n_head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: (conv_id, n_turns), and (conv_id, place, digest, n_chars).

    The first ``n_head`` (at most ``most``) turns of a conversation are those of its ``template``, all if that has fewer, none if there
    is no such conversation; its own turns from number ``n_head`` on follow. Both are expressions of conv_id.
    """
    where = stage(parts(turns))
    convs = where.select("conv_id", "n_turns").distinct()
    lengths = convs.select(F.col("conv_id").alias("template"), F.col("n_turns").alias("have"))
    asked = convs.withColumns({"template": template, "h": n_head.cast("long")}).join(lengths, "template", "left")
    asked = stage(asked.select("conv_id", "template", "h", "n_turns", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")))

    at = F.col("before") + F.col("nth") - F.col("first")
    here = turns.join(where.join(asked.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "part", "first", "before", "h", "taken"), ["conv_id", "part"])
    own = here.select("conv_id", at.alias("place"), "h", "taken", "digest", "n_chars")
    first = stage(own.where(F.col("place") < most).select(F.col("conv_id").alias("template"), "place", "digest", "n_chars").join(asked.select("template").distinct(), "template", "left_semi"))
    heads = asked.join(first, "template").where("place < taken").select("conv_id", "place", "digest", "n_chars")
    tails = own.where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "n_chars")
    sizes = asked.select("conv_id", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))
    return sizes, stage(heads.unionByName(tails))


def prefixes(turns: DataFrame, stage: Scratch) -> DataFrame:
    """Staged (conv_id, depth, a, b, parent_a, parent_b, n_chars): for each turn the prefix that ends with it."""
    lane = lambda k: F.xxhash64("digest", "place", F.lit(k))
    cut = turns.withColumns({"chunk": F.floor(F.col("place") / CHUNK).cast("long"), "own_a": lane(1), "own_b": lane(2)})
    within = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumns({x: F.bit_xor(f"own_{x}").over(within) for x in "ab"})
    # Few conversations have a second chunk: only their rows are joined with what stands before.
    totals = cut.groupBy("conv_id", "chunk").agg(*(F.bit_xor(f"own_{x}").alias(f"all_{x}") for x in "ab"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({f"before_{x}": F.bit_xor(f"all_{x}").over(before) for x in "ab"}).select("conv_id", "chunk", "before_a", "before_b")
    later = inner.where("chunk > 0").join(offsets.where("chunk > 0"), ["conv_id", "chunk"]).withColumns({x: F.col(x).bitwiseXOR(F.col(f"before_{x}")) for x in "ab"})
    found = inner.where("chunk = 0").unionByName(later.drop("before_a", "before_b"))
    return stage(found.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", *(F.col(x).bitwiseXOR(F.col(f"own_{x}")).alias(f"parent_{x}") for x in "ab"), "n_chars"))


def nodes(sizes: DataFrame, found: DataFrame, stage: Scratch) -> DataFrame:
    """Staged (v, depth, a, b, conv_id, n_convs, n_chars, parent, parent_depth, parent_conv_id, n_children) per distinct prefix, the empty one included."""
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *(zero.alias(k) for k in KEY), *(F.lit(None).cast("long").alias(f"parent_{x}") for x in "ab"), "conv_id", "n_convs", zero.alias("n_chars"))
    some = found.groupBy(*KEY).agg(F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars"))
    own = stage(root.unionByName(some.select(*root.columns)).withColumn("v", F.monotonically_increasing_id()))
    up = {"depth": "parent_depth", "a": "parent_a", "b": "parent_b"}
    below = stage(own.where("depth > 0").withColumn("parent_depth", F.col("depth") - 1))
    counts = stage(below.groupBy(*up.values()).agg(F.count("*").alias("n_children")))
    parents = own.select("v", *KEY, "conv_id").withColumnsRenamed(up | {"v": "parent", "conv_id": "parent_conv_id"}).join(counts, [*up.values()])
    linked = join_groups(below, stage(parents), [*up.values()], "n_children").drop("n_children")
    linked = linked.unionByName(own.where("depth = 0").withColumns({c: F.lit(None).cast("long") for c in ("parent_depth", "parent", "parent_conv_id")}))
    children = counts.withColumnsRenamed({p: k for k, p in up.items()})
    return stage(linked.drop("parent_a", "parent_b").join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _listed(ends: DataFrame) -> DataFrame:
    """(v, conv_id, text): the ids of each node, ascending and joined by commas, in pieces; ``conv_id`` is a piece's first."""
    def run(batches):
        v, first, ids, out = None, None, [], []

        def close():
            out.append((v, first, ",".join(ids)))
            ids.clear()

        for b in batches:
            held = 0
            for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (node != v or held > PIECE):
                    close()
                if not ids:
                    v, first, held = node, conv, 0
                ids.append(str(conv))
                held += len(ids[-1]) + 1
            if ids:
                close()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["v", "conv_id", "text"])
            out.clear()

    return ends.select("v", "conv_id").repartitionByRange("v", "conv_id").sortWithinPartitions("v", "conv_id").mapInArrow(run, "v long, conv_id long, text string")


def end_digests(ends: DataFrame, stage: Scratch) -> DataFrame:
    """(v, ends_sha256) of (v, conv_id): SHA-256 of a node's ids as `_listed` joins them; its pieces stream by."""
    def run(batches):
        v, state = None, None
        for b in batches:
            found = []
            for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if node != v:
                    if v is not None:
                        found.append((v, state.hexdigest()))
                    v, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["v", "ends_sha256"])
        if v is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([state.hexdigest()])], names=["v", "ends_sha256"])

    pieces = stage(_listed(ends))
    return pieces.repartition("v").sortWithinPartitions("v", "conv_id").select("v", "text").mapInArrow(run, "v long, ends_sha256 string")


def shared_prefixes(conversations: DataFrame, template: Column, n_head: Column, most_head: int) -> DataFrame:
    """One row per node of the trie of conversations that are rebuilt as in `with_shared_heads`.

    conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (of its subtree),
    saved_tokens (code points that a store of prefixes saves in its subtree), ends_sha256 (of the members that end here).
    A plain trie has ``n_head`` 0.
    """
    stage = Scratch(conversations.sparkSession)
    sizes, turns = with_shared_heads(ordered_turns(conversations, stage), stage, template, n_head, most_head)
    found = prefixes(turns, stage)
    trie = nodes(sizes, found, stage)
    tree = stage(trie.select("v", "parent", "depth", "parent_depth", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                             ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens")))
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"], stage)

    last = found.join(sizes.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(*KEY, "conv_id")
    bare = sizes.where("n_turns = 0").select(*(F.lit(0).cast("long").alias(k) for k in KEY), "conv_id")
    last = stage(last.unionByName(bare))
    ends = join_groups(last, stage(trie.select("v", *KEY).join(last.groupBy(*KEY).agg(F.count("*").alias("n")), KEY)), KEY)
    out = trie.join(totals, "v").join(end_digests(ends, stage), "v", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return stage.result(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
