"""The trie of conversations and tree contraction, against plain loops."""

import hashlib
import random
import zlib

import pytest

from saunter.llm import contraction, prefix_trie, registry, shared

COLS = "conv_id long, turn long, role string, text string, v long, depth string, a string, nth long, part string, n_turns string"


def conversations(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "d", "a", 7, None, "n") for r in rows], COLS)


def brute(table):
    own = {}
    for c, turn, role, text in table:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(x)] for c, x in own.items()}
    nodes = {}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
                    sum(not any(x[: len(k)] == k and len(x) > len(k) for x in below) for k in below),
                    sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def trie(df):
    conv = shared.F.col("conv_id")
    return prefix_trie.shared_prefixes(df, conv - conv % 100, shared.crc_mod("conv_id", 6), 5)


@pytest.mark.parametrize("chunk,piece", [(4096, 1 << 16), (3, 8)])
def test_trie_is_brute_force(spark, monkeypatch, chunk, piece):
    """Also with several chunks a conversation and several pieces a node."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    r = random.Random(chunk)
    table = []
    for c in [*range(30), *range(95, 130), 200, 345, 346]:  # 300 is absent: conversations without a template
        for t in range(r.choice([0, 1, 2, 3, 5, 9]) if c % 100 else 7):
            table.append((c, t, r.choice("ua"), r.choice(["x", "yy", "é\U0001f600z", ""]) if t < 3 else "same"))
    table += [(7, None, None, None), (7, None, "u", "tie"), (7, None, "u", "tie"), (8, 1, "u", "b"), (8, 1, "u", "a"), (None, 0, "u", "no conversation"), (None, None, None, None)]
    table += [(11, t, "u", "long " * 3) for t in range(40)] + [(111, 0, "u", "w" * 100_000)]
    table += [(k, 0, "u", "all alike") for k in range(1000, 1090)]  # a node with many members
    r.shuffle(table)
    assert found(trie(conversations(spark, table))) == brute(table)


def test_empty_table_and_turnless_conversations(spark):
    assert trie(conversations(spark, [])).count() == 0
    table = [(c, 0, "u", "t") for c in (301, 302, 303, 304, 305)]  # no template: turns before h are gone
    assert found(trie(conversations(spark, table))) == brute(table)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_subtree_sums(spark, shape):
    r, n = random.Random(3), 150
    up = {"chain": lambda k: k - 1, "star": lambda k: 0, "random": lambda k: r.randrange(k), "caterpillar": lambda k: (k - 1) // 2 * 2 - (k > 2) * 0 if k % 2 else k - 2}[shape]
    parent = [None] + [up(k) for k in range(1, n)] + [None]  # the last is a tree of its own
    depth, kids, want = [0] * (n + 1), [0] * (n + 1), [[1, k * k] for k in range(n + 1)]
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
        kids[parent[k]] += 1
    for k in range(n - 1, 0, -1):
        for s in (0, 1):
            want[parent[k]][s] += want[k][s]
    tree = spark.createDataFrame([(k + 5, None if p is None else p + 5, depth[k], None if p is None else depth[p], kids[k], 1, k * k) for k, p in enumerate(parent)],
                                 "v long, parent long, depth long, parent_depth long, n_children long, size long, squares long")
    stage = shared.Scratch(spark)
    got = {r["v"] - 5: [r["size"], r["squares"]] for r in contraction.subtree_sums(stage(tree), ["size", "squares"], stage).collect()}
    assert got == dict(enumerate(want))
    assert contraction.subtree_sums(stage(tree.limit(0)), ["size", "squares"], stage).count() == 0


def test_query_is_brute_force_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(registry.op11_conversation_trie(spark, sf)) == brute(table)
