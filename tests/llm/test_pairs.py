"""Near and exact duplicates, repeated lines: against brute force, with the edge cases of inputs."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saunter.llm import exact_dedup, graph, line_dedup, ngram_join, passages, rtree, shared
from saunter.llm.words import HashedWords

COLS = "doc_id long, text string, lang string, keep_id string, group_size long, _id string, row string, sig string, start string, spans string"


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "x", 7, "y", "z", None, "s", None) for i, t in zip(ids, texts)], COLS)


def words(t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[top(k)] = min(best.get(top(k), i), i)
    return sorted((str(i), len(sets[k]), str(best.get(top(k), i) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def near_copies(seed=1, n=40):
    """Groups of near copies, chains of them, shared passages, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = ["", None, " \n\t", "one", "ONE", "one two three four", "One two  three\nfour", "é è é è é è é"]
    for _ in range(n):
        base = [word() for _ in range(r.randint(5, 120))] + (passage if r.random() < 0.4 else [])
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):  # a chain: each copy changes the one before
            base = list(base)
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = word()
            out.append(" ".join(base))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block,far", [(512, 8), (3, 0), (3, 10**9)])
def test_components_are_brute_force(spark, monkeypatch, block, far):
    """With blocks of any size, and with some, all or no elements far above the mean."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FAR_ABOVE", far)
    texts = near_copies()
    texts += [texts[9], texts[9]]
    ids = [None if k == 12 else k * 3 % 1009 for k in range(len(texts) - 1)] + [27]
    docs = table(spark, texts, ids)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.jaccard_components(docs).collect())
    assert got == brute_components(list(zip(ids, texts)))


def test_group_of_near_copies_with_outsiders(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(80):  # about half of the pairs are links
        copy = list(base)
        for j in r.sample(range(100), 2 + k % 3):
            copy[j] = f"x{k}-{j}"
        texts.append(" ".join(copy))
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in ngram_join.jaccard_components(table(spark, texts)).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_one_of_each_component_stays(spark):
    texts = near_copies(3, 12)
    docs = table(spark, texts)
    kept = ngram_join.keep_one(docs)
    want = {int(c) for _, n, c in brute_components(list(enumerate(texts)))}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert ngram_join.keep_one(docs.limit(0)).count() == 0 and ngram_join.jaccard_components(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=300), min_size=2, max_size=40), st.integers(51, 100))
def test_rtree_loses_no_similar_pair(sets, percent):
    hashed = [np.array(sorted(hash((x, 7)) & (1 << 63) - 1 for x in s), dtype=np.uint64) for s in sets]
    sizes = np.array([len(h) for h in hashed])
    found = set()
    for a, b in rtree.candidate_pairs([rtree.group_counts(h) for h in hashed], sizes, np.arange(len(sets)), percent):
        found |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert (j, i) in found
            assert ngram_join.similar(hashed[i], hashed[j], percent) == (100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))


def test_a_round_of_components_shuffles_its_labels_once(spark):
    """One shuffle of the labels' table serves its three joins; three of them were a third of a round's tasks."""
    own, plans = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}, []

    def stage(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.staged(df)

    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        graph.components(spark.range(1, 9).selectExpr("id a", "id - 1 b"), stage)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(plans) > 3 and all(p.count("ReusedExchange") == 2 for p in plans[2:])


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["comp"] for r in graph.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, keep, weak):
    texts = ["a", "b", "a", None, "", "a ", "long " * 5000, "long " * 5000, "b", "c"]
    ids = [5, 3, 9, 1, 2, 4, 8, 7, None, 6]
    kw = {"content_hash": lambda c: F.substring(F.md5(c), 1, 1)} if weak else {}
    got = exact_dedup.mark_duplicates(table(spark, texts, ids), keep=keep, **kw).collect()
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    want = []
    for i, t in zip(ids, texts):
        g = groups[t or ""]
        k = pick(x for x in g if x is not None)
        want.append((str(i), k, len(g), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want)


def test_exact_dedup_drops_rows(spark):
    docs = table(spark, ["a", "a", "b", "b", None, ""], [1, 2, 3, 3, 4, 5])
    kept = exact_dedup.drop_duplicates(docs, keep="largest")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_exact_dedup_keeps_columns_of_any_name(spark):
    docs = table(spark, ["a", "a", "b"], [1, 2, 3]).withColumns({"dedup_sha": F.lit("s"), "dedup_id": F.lit("i"), "marks": F.lit("m"), "__dedup_sha": F.lit("t")})
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["dedup_sha"], r["dedup_id"], r["marks"], r["__dedup_sha"]) for r in kept.collect()) == [(1, "s", "i", "m", "t"), (3, "s", "i", "m", "t")]


def test_links_with_null_ends(spark):
    links = spark.createDataFrame([(3, 1), (3, 1), (5, 5), (None, 7), (8, None)], "a long, b long")
    assert {r["v"]: r["comp"] for r in graph.components(links).collect()} == {1: 1, 3: 1, 5: 5}
    assert graph.components(links.limit(0)).count() == 0


def test_repeated_lines(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [f"start\n{long}\nend", f"{long.upper()}\nother", None, "", f"x\n\n  {long.replace(' ', '  ')} \n{long}", "short line\nshort line"]
    docs = table(spark, texts)
    found = sorted((r["doc_id"], r["unit"], r["start"], r["end"], r["keep_id"], r["keep_unit"]) for r in line_dedup.find_repeats(docs).collect())
    assert found == [(1, 0, 0, len(long), 0, 1), (4, 2, 3, 3 + len(long) + 59 + 3, 0, 1), (4, 3, 3 + len(long) + 59 + 4, 3 + 2 * len(long) + 59 + 4, 0, 1)]
    clean = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(docs).collect()}
    assert clean == {0: texts[0], 1: "other", 2: None, 3: "", 4: "x\n\n", 5: texts[5]}
    assert line_dedup.find_repeats(docs.limit(0)).count() == 0
    assert line_dedup.find_repeats(docs, least_words=1).where("doc_id = 5").count() == 1


def test_repeated_text_sees_short_lines(spark):
    docs = table(spark, ["one short line\nown words", "other words\nOne  short line\n\n", "\n \n", None, "x\nx"])
    found = sorted((r["doc_id"], r["unit"], r["start"], r["end"], r["keep_id"], r["keep_unit"]) for r in line_dedup.repeated_text(docs).where("kind = 'line'").collect())
    assert found == [(1, 1, 12, 27, 0, 0), (4, 1, 2, 3, 4, 0)]


def brute_passages(texts, least):
    """Characters of repeated windows per text, by comparing every window with those before it."""
    first, out = {}, {}
    for i, t in enumerate(texts):
        spans, w = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")], words(t)
        for k in range(len(w) - least + 1):
            j, q = first.setdefault(tuple(w[k : k + least]), (i, k))
            if (j, q) != (i, k):
                start = spans[q + least - 1][1] if j == i and k < q + least else spans[k][0]
                out.setdefault(i, set()).update(c for c in range(start, spans[k + least - 1][1]) if not t[c].isspace())
    return out


def passage_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 5)))
    pool = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 120, 12, 8)]
    texts = [None, "", "a " * 160, " ".join(f"p{k % 7}" for k in range(130)), "x y"]
    for _ in range(40):
        parts = [w for _ in range(r.randint(1, 4)) for w in [word() for _ in range(r.randint(0, 30))] + r.choice(pool)]
        texts.append("".join(w.upper() * (w[0] == "a") or w for w in (x + r.choice((" ", "  ", "\n", "\t")) for x in parts)))
    return texts


def test_passages_inside_other_lines(spark):
    texts = passage_texts()
    got = {}
    for x in passages.find_passages(table(spark, texts)).collect():
        t = texts[x["doc_id"]]
        span = {c for c in range(x["start"], x["end"]) if not t[c].isspace()}
        assert not span & got.setdefault(x["doc_id"], set()) and x["n_words"] == len(words(t[x["start"] : x["end"]]))
        got[x["doc_id"]] |= span
    assert got == brute_passages(texts, 50) and len(got) > 20
    assert passages.find_passages(table(spark, texts).limit(0)).count() == 0
    run = " ".join(f"w{k}" for k in range(50))
    docs = table(spark, [f"own start {run} own end", f"another line\nbegins {run.replace(' 9', chr(10) + '9')} and goes on"])
    (x,) = line_dedup.repeated_text(docs).collect()
    assert (x["kind"], x["doc_id"], x["unit"], x["start"], x["n_words"], x["keep_id"], x["keep_unit"]) == ("passage", 1, 3, 20, 50, 0, 2)


def unit_starts(texts):
    """Earliest (text, word) of each line and of each run of 35 words."""
    lines, runs = {}, {}
    for i, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n"):
            w = words(line)
            if w:
                lines.setdefault(tuple(w), (i, at))
            at += len(w)
        w = words(t)
        for k in range(len(w) - 34):
            runs.setdefault(tuple(w[k : k + 35]), (i, k))
    return lines, runs


def test_units_to_remove(spark):
    """Whatever goes lies in a line or a run that stands earlier; of every 50 words that do, some go."""
    texts = passage_texts()
    r = random.Random(8)
    texts += ["\n".join(r.choice(["a short line", "one more line of words", " ".join(f"q{k}" for k in range(30)), " ".join(r.choice("xyz") * 2 for _ in range(9))]) for _ in range(12)) for _ in range(6)]
    lines, runs = unit_starts(texts)
    gone = {i: set() for i in range(len(texts))}
    for x in line_dedup.find_units(table(spark, texts)).collect():
        t, new = texts[x["doc_id"]], set(range(x["word"], x["word"] + x["n_words"]))
        assert words(t[x["start"] : x["end"]]) == words(t)[x["word"] : x["word"] + x["n_words"]] and x["n_words"] >= 20
        assert not new & gone[x["doc_id"]] and x["keep_id"] <= x["doc_id"]
        gone[x["doc_id"]] |= new
    for i, t in enumerate(texts):
        w, held, at = words(t), set(), 0
        for line in (t or "").split("\n"):
            n = len(words(line))
            if n and lines[tuple(words(line))] != (i, at):
                held |= set(range(at, at + n))
            at += n
        for k in range(len(w) - 34):
            if runs[tuple(w[k : k + 35])] != (i, k):
                held |= set(range(k, k + 35))
        assert gone[i] <= held
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 49):
            j, q = first.setdefault(tuple(w[k : k + 50]), (i, k))
            if j != i:
                assert len(gone[i] & set(range(k, k + 50))) >= 35
            elif k >= q + 50:
                assert gone[i] & set(range(k, k + 50))
    assert sum(map(bool, gone.values())) > 20
    assert line_dedup.find_units(table(spark, texts).limit(0)).count() == 0


def test_units_go_from_their_rows(spark):
    """Ids may repeat or be null: rows are told apart, other rows and columns stay as they are."""
    run = " ".join(f"w{k}" for k in range(60))
    texts = [f"{run}\nfirst", f"second\n{run}", "other text", f"{run}\nthird", None, run]
    docs = table(spark, texts, [7, 7, 7, None, None, 3]).withColumn("row_number", F.lit("mine"))
    clean = line_dedup.remove_units(docs)
    assert clean.columns == docs.columns and {r["row_number"] for r in clean.collect()} == {"mine"}
    got = sorted((str(r["doc_id"]), words(r["text"]), r["text"] is None) for r in clean.collect())
    want = [("3", words(run), False), ("7", ["first"], False), ("7", ["second"], False), ("7", ["other", "text"], False), ("None", ["third"], False), ("None", [], True)]
    assert got == sorted(want)
    lines = line_dedup.remove_repeats(docs)
    assert sorted((str(r["doc_id"]), words(r["text"]), r["text"] is None) for r in lines.collect()) == sorted(want)
    assert line_dedup.remove_units(docs.limit(0)).count() == 0 == line_dedup.remove_repeats(docs.limit(0)).count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\u3000\x85\n\t\x0b\x1c Z", max_size=40) | st.text(max_size=20) | st.text("x", min_size=15, max_size=40), max_size=6))
def test_hashed_words_are_the_words(texts):
    w = HashedWords([t.encode() for t in texts])
    chars = w.characters()
    known = {}
    for k, t in enumerate(texts):
        own, first = words(t), w.firsts[k]
        assert w.firsts[k + 1] - first == len(own)
        spots = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        assert [(int(chars[w.starts[first + n]] - chars[w.begins[k]]), int(chars[w.ends[first + n]] - chars[w.begins[k]])) for n in range(len(own))] == spots
        for n, x in enumerate(own):
            assert known.setdefault(x, int(w.hashes[first + n])) == w.hashes[first + n]
    assert len(set(known.values())) == len(known)


def test_bitmap_loses_no_key(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 700).cast("string").alias("k"), F.lit(1).alias("marks"))
    keys = rows.where("id % 11 = 0").select("k").distinct()
    some, rest = shared.split_likely(rows, keys, ["k"])
    assert some.columns == rest.columns == rows.columns and some.count() + rest.count() == 2000
    assert rest.join(keys, "k").count() == 0 and some.count() < 1.1 * rows.join(keys, "k").count()
    assert shared.likely(rows, keys.limit(0), ["k"]).count() == 0


def test_bitmap_has_the_size_of_its_keys(spark):
    """What is broadcast follows the number of keys, up to the full bitmap; no key is lost and few others pass."""
    assert [shared.bits_for(n) for n in (0, 1, 511, 512, 10**5, 10**9)] == [16, 16, 16, 17, 24, shared.FILTER_BITS]
    rows = spark.range(20000).selectExpr("id", "cast(id as string) k")
    keys = rows.where("id % 20 = 0").select("k")
    some, rest = shared.split_likely(rows, keys, ["k"], shared.bits_for(1000))
    assert rest.join(keys, "k").count() == 0 and 1000 <= some.count() < 1300 and some.count() + rest.count() == 20000


def test_long_texts_are_compared_whole(spark):
    """Texts of thousands of words that differ behind their beginning."""
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    near, far = list(base), list(base)
    near[5000:5100] = [f"n{k}" for k in range(100)]
    far[2500:] = [f"f{k}" for k in range(3500)]
    texts = [" ".join(x) for x in (base, near, far)] + ["y " * 20_000]
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in ngram_join.jaccard_components(table(spark, texts)).collect())
    assert got == brute_components(list(enumerate(texts)))
    found = line_dedup.find_units(table(spark, texts)).collect()
    assert {x["doc_id"] for x in found} == {1, 2, 3}


def test_near_copies_with_null_ids(spark):
    base = " ".join(f"w{k}" for k in range(100))
    texts = [base, f"{base} x", f"{base} y", "alone here", " ".join(f"v{k}" for k in range(90)), " ".join(f"v{k}" for k in range(91)), None]
    docs = table(spark, texts, [5, None, 2, None, None, None, None]).withColumn("near_id", F.lit("mine"))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect())
    assert len(got) == 4 and got[0] == ("2", "w0 w1") and [x[1] for x in got[1:]] == ["", "alone", "v0 v1"]


def test_passage_of_repeated_rows(spark):
    run = " ".join(f"w{k}" for k in range(60))
    found = passages.find_passages(table(spark, [run] * 4, [7, 7, None, None])).collect()
    assert sorted((str(x["doc_id"]), x["keep_id"], x["n_words"]) for x in found) == [("7", 7, 60), ("None", 7, 60), ("None", 7, 60)]


def test_repeated_rows_keep_one_unit(spark):
    long = " ".join(f"w{k}" for k in range(30))
    assert line_dedup.find_repeats(table(spark, [long] * 3, [7, 7, None])).count() == 2


def test_rows_of_one_id_are_told_apart(spark):
    """A near copy goes alone: not another row of its id. Repeated rows leave one, null ids come last."""
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    rows = [(1, " ".join(base)), (5, near(1)), (5, "another text with words of its own"), (None, near(2)), (None, "alone and long enough to be told"), (7, "twice the same words here again"), (7, "twice the same words here again"), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, `near_id` string").repartition(3)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[7], rows[8]], key=str)


@pytest.mark.parametrize("operator", ["drop_duplicates", "keep_one", "remove_units", "remove_repeats", "cut_contaminated", "drop_contaminated", "language"])
def test_names_with_dots_and_spaces(spark, operator):
    import corpus_pipeline
    from saunter.llm import decontam

    rows = [(k, f"{'one two three four five six seven eight nine ten eleven twelve ' * 2}{k % 2}", "en", "x", k) for k in range(4)] + [(9, None, "en", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, `c d` int")
    bench = spark.createDataFrame([(1, "no such words in any of the documents that are here now")], "item_id long, text string")
    use = {"drop_duplicates": exact_dedup.drop_duplicates, "keep_one": ngram_join.keep_one, "remove_units": line_dedup.remove_units, "remove_repeats": line_dedup.remove_repeats,
           "cut_contaminated": lambda d: decontam.cut_contaminated(d, bench), "drop_contaminated": lambda d: decontam.drop_contaminated(d, bench), "language": lambda d: corpus_pipeline.language(spark, d, "")}
    out = use[operator](docs)
    assert out.columns == docs.columns and out.count() > 0 and {r["a.b"] for r in out.collect()} == {"x"}


def test_a_join_holds_a_slice_on_disk_at_a_time(spark, monkeypatch):
    """In many slices components are those of brute force; tables go once nothing reads them, and shuffle files with their execution."""
    for name in ("SLICE_ELEMENTS", "SLICE_MEMBERS", "SLICE_SETS"):
        monkeypatch.setattr(ngram_join, name, 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    dropped, drop = [], shared.Scratch.drop
    monkeypatch.setattr(shared.Scratch, "drop", lambda self, *tables: dropped.append(tables) or drop(self, *tables))
    texts = near_copies()
    got = sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in ngram_join.jaccard_components(table(spark, texts)).collect())
    assert got == brute_components(list(enumerate(texts)))
    assert len(dropped) > 2 * ngram_join.MOST_SLICES

    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before = shuffle_files()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(shared.staged(rows).collect()) == 7
    deadline = time.time() + 20  # Spark deletes them in the background
    while shuffle_files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files() - before
