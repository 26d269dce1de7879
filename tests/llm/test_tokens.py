"""Token ids, packing, the token store and token counts: against the libraries and brute force."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from saunter.llm import packing, token_count, token_store, tokens
from tests.llm.test_pairs import table

TEXTS = ["", None, "The cat's hat, 12 ÜBER straße!", "a" * 3000, "it's don't I'LL we've", "naïve été  x y\tz\r\nq", "東京 😀 ½ ²", "<|endoftext|> x", "!!! ... ---",
         "ǅ İstanbul ΣΑΣ µm ß ẞ", "word " * 9000, "line\nline\n\nline  "]


@lru_cache
def loaded(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def direct(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
@example("a'S 's'S it's.' ́a é́")
@example("İßſK")
def test_memo_is_the_library(text):
    lib = loaded(tokens.default_vocabulary())
    assert np.frombuffer(tokens.encoder(tokens.default_vocabulary()).encode(text), "<u4").tolist() == direct(lib, text)


def test_given_texts(library, encoder):
    for t in TEXTS:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == direct(library, t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(max_size=40) | st.text(alphabet="aZé'ß.,-| \n\t1İſ́<", max_size=40), max_size=6))
@example(["<|endoftext|>, x", "", None, "it's, ÀÉ!? ×÷ a.b 'a ,,", "x" * 3000 + "."])
def test_texts_together_are_the_library(texts):
    lib, column = loaded(tokens.default_vocabulary()), pa.array(["left out", *texts], pa.string()).slice(1)
    ids, ends = tokens.encoder(tokens.default_vocabulary()).encode_all(column)
    want = [direct(lib, t) for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).astype(int).tolist()


def test_texts_together_look_up_distinct_words():
    """Of words that repeat with other punctuation and case, only the distinct letters are asked for."""
    words, asked = tokens.WordEncoder(tokens.default_vocabulary()), []
    words._core = lambda piece, find=words._core: asked.append(piece) or find(piece)
    words.encode_all(pa.array(["The cat, the CAT. THE cat! " * 500, "cat; the"]))
    assert sorted(asked) == [*"!,.;", "cat", "the"] and len(words) <= 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_everything(seed):
    r = random.Random(seed)
    top = 100
    histogram = {r.randint(1, top): r.randint(1, 400) for _ in range(r.randint(1, 60))}
    rows = packing.plan_rows(histogram, top)
    bins = {}
    for length, n in histogram.items():
        own = rows[rows[:, 0] == length]
        for rank in range(n):
            row = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            q = rank - row[1]
            bins.setdefault(row[3] + q // row[2], []).append((row[4] + q % row[2] * length, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= top
    small = sum(k * n for k, n in histogram.items())
    lower = max(-(-small // top), sum(n for k, n in histogram.items() if 2 * k > top))
    assert lower <= len(bins) <= lower * 1.35 + 2


def test_plan_rejects_what_does_not_fit():
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, 100)
    assert packing.plan_bins({}, 100) == []


def test_packing(spark, library):
    docs = table(spark, [*TEXTS, TEXTS[2]], [*range(len(TEXTS)), None])
    rows = packing.pack_documents(docs, with_ids=True)
    got = rows.collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = direct(library, t)
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["length"] == 4096 for r in own[:-1]) and [r["start"] for r in own] == [4096 * k for k in range(len(own))]
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in own)
    assert sum(r["doc_id"] is None for r in got) == 1
    for s in packing.sequences(rows).collect():
        parts = sorted((r["offset"], bytes(r["ids"])) for r in got if r["sequence_id"] == s["sequence_id"])
        assert b"".join(p for _, p in parts) == bytes(s["ids"]) and len(s["ids"]) == 4 * s["length"] <= 4 * 4096
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_other_vocabularies_get_whole_texts(spark):
    """One that keeps spaces: ids are those of the library for the whole text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), tokens.encoder(path)
    assert not own.spaced and tokens.encoder(tokens.default_vocabulary()).spaced
    for t in TEXTS:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == direct(lib, t)
    docs = table(spark, TEXTS)
    got = {r["doc_id"]: r["n_tokens"] for r in token_store.read_back(spark, token_store.write_store(docs, vocabulary=path)).where("verified").collect()}
    assert got == {i: len(direct(lib, t)) for i, t in enumerate(TEXTS)}


def test_ranks_within_a_length_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    rows = packing.pack_documents(table(spark, ["one two"] * 40 + ["one"] * 5 + ["word " * 5000])).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=700), min_size=1, max_size=5), st.integers(0, 3))
def test_cuts_of_streams_are_cuts_of_each(streams, bits):
    """Streams cut together are cut like each alone; small numbers of bits make many marks."""
    was = token_store.CUT_BITS
    token_store.CUT_BITS = bits + 1
    try:
        ends = np.cumsum([len(s) for s in streams]).tolist()
        found, of = token_store.cuts_of(np.array([x for s in streams for x in s], "<u4"), ends)
        for k, s in enumerate(streams):
            own = [e - (ends[k - 1] if k else 0) for e, o in zip(found, of) if o == k]
            assert own == token_store.cuts(np.array(s, "<u4"))
            assert not s or own[-1] == len(s)
            assert all(token_store.LEAST <= b - a <= token_store.MOST for a, b in zip([0, *own], own[:-1]))
    finally:
        token_store.CUT_BITS = was


def test_store_of_null_ids(spark, library):
    docs = table(spark, ["a b", None, "c d e", "a b"], [None, None, 2, 1])
    got = token_store.read_back(spark, token_store.write_store(docs)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2] and all(r["verified"] for r in got)
    assert sorted(r["n_tokens"] for r in got[:2]) == [1, len(direct(library, "a b"))] and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


def test_store_round_trip(spark, library):
    docs = table(spark, [*TEXTS, TEXTS[10]], [*range(len(TEXTS), 0, -1), 3])
    path = token_store.write_store(docs)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) for r in token_store.read_back(spark, path).collect())
    want, start = [], 0
    for i, t in sorted([*zip(range(len(TEXTS), 0, -1), TEXTS), (3, TEXTS[10])], key=lambda x: x[0]):
        ids = direct(library, t)
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True))
    assert sorted((a, n, c, v) for a, _, n, c, v in got) == sorted(want)
    for i, s, n, _, _ in sorted(got, key=lambda x: x[1]):
        assert s == start
        start += n
    assert [x[0] for x in sorted(got, key=lambda x: x[1])] == sorted(x[0] for x in got)
    again = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_store.reconstruct(spark, path).collect())
    assert again == sorted((i, direct(library, t)) for i, t in [*zip(range(len(TEXTS), 0, -1), TEXTS), (3, TEXTS[10])])
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()


def test_damage_is_seen(spark, tmp_path):
    path = token_store.write_store(table(spark, ["a b c", "d e f"]), f"file://{tmp_path}/store")
    files = list((tmp_path / "store" / "chunks").glob("part-*.parquet"))
    for f in files:
        t = pq.read_table(f)
        ids = [x[:-1] + bytes([x[-1] ^ 1]) for x in t.column("ids").to_pylist()]
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        pq.write_table(t.set_column(t.schema.get_field_index("ids"), "ids", [ids]), f)
    assert {r["verified"] for r in token_store.read_back(spark, path).collect()} == {False}


def test_chunks_of_many_documents_and_lost_ones(spark, tmp_path):
    texts = ["one text of many rows"] * 40 + [f"text of row {i}" for i in range(20)]
    path = token_store.write_store(table(spark, texts), f"file://{tmp_path}/store")
    assert all(r["verified"] for r in token_store.read_back(spark, path).collect())
    ids = {r["doc_id"]: bytes(r["ids"]) for r in token_store.reconstruct(spark, path).collect()}
    assert len(ids) == 60 and len(set(ids.values())) == 21
    crcs = {r["doc_id"]: r["ids_crc32"] for r in token_store.read_back(spark, path).collect()}
    assert crcs == {k: zlib.crc32(x) for k, x in ids.items()}

    chunks = spark.read.parquet(f"{path}/chunks")
    many = spark.read.parquet(f"{path}/recipes").select(F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").count().where("count = 40")
    left = f"file://{tmp_path}/left"
    chunks.join(many, "chunk_id", "left_anti").write.parquet(f"{left}/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{left}/{part}")
    got = token_store.read_back(spark, left).collect()
    assert len(got) == 60 and sorted(crcs[r["doc_id"]] == r["ids_crc32"] for r in got) == [False] * 40 + [True] * 20
    assert {r["verified"] for r in got if r["ids_crc32"] is None} == {False}
    assert sum(r["ids"] is None for r in token_store.reconstruct(spark, left).collect()) == 40


def test_empty_store(spark):
    assert token_store.read_back(spark, token_store.write_store(table(spark, ["x"]).limit(0))).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=40), min_size=1, max_size=6), min_size=1, max_size=8))
def test_checksums_combine(docs):
    flat = [p for d in docs for p in d]
    firsts = np.cumsum([0, *map(len, docs)])[:-1]
    got = token_store.combine(np.array([zlib.crc32(p) for p in flat]), np.array([len(p) for p in flat]), firsts)
    assert got.tolist() == [zlib.crc32(b"".join(d)) for d in docs]


def test_equal_passages_give_equal_chunks():
    r = np.random.default_rng(1)
    passage = r.integers(0, 49_000, 6000).astype("<u4")
    a, b = (np.concatenate([r.integers(0, 49_000, n).astype("<u4"), passage]) for n in (777, 1234))
    parts = lambda x: {x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x))}
    assert len(parts(a) & parts(b)) >= 4


def greedy(word, pieces):
    """Longest match by trying every length."""
    text, at, n = token_count.MARK + word, 0, 0
    while at < len(text):
        for end in range(len(text), at, -1):
            if text[at:end] in pieces and (at == 0 or not text[at:end].startswith(token_count.MARK)):
                break
        else:
            return None
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc▁", min_size=1, max_size=4), max_size=25), st.text("abcd", min_size=1, max_size=14))
def test_automaton_is_greedy(pieces, word):
    pieces = {p for p in pieces if token_count.MARK not in p[1:]}
    assert token_count.Automaton(sorted(pieces)).count(word) == greedy(word, pieces)


def test_token_counts(spark):
    pieces = set(token_count.read_pieces(token_count.default_vocabulary()))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_count.count_tokens(table(spark, TEXTS)).collect()}
    by_word = {w: greedy(w, pieces) for t in TEXTS for w in (t or "").split()}
    for i, t in enumerate(TEXTS):
        each = [by_word[w] for w in (t or "").split()]
        assert got[i] == (len(each), sum(1 if n is None else n for n in each), each.count(None))
    assert token_count.count_tokens(table(spark, TEXTS).limit(0)).count() == 0


def test_text_of_very_many_secrets(spark):
    """Spans of 20,000 matches of two kinds in one text, in seconds: sums run in blocks."""
    import time

    from saunter.llm import secrets

    n, step = 20_000, 50
    text = "".join(f"token=abcd{k:06d} {'0123456789abcdef' * 2} " for k in range(n))
    began = time.time()
    row = secrets.find_secrets(spark.createDataFrame([(1, text), (2, text[: 700 * step])], "doc_id long, text string")).where("doc_id = 1").first()
    assert time.time() - began < 60 and (row["n_assign"], row["n_hex"]) == (n, n)
    assert row["base_spans"] == ",".join(f"assign:{k * step}:{k * step + 16},hex:{k * step + 17}:{k * step + 49}" for k in range(n))


def test_a_worker_keeps_its_own_operator_s_things_alone():
    import pyarrow as pa

    from saunter.llm import words

    made = []
    keep = words.kept_by_worker(lambda key: made.append(key) or object())
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None, ""]})
    first = keep(1)
    assert [b.num_rows for b in words.slices([batch], "text", own=keep)] == [3] and keep(1) is first
    assert [b.num_rows for b in words.slices([batch], "text", most=1)] == [1, 2]
    assert keep(1) is not first and made == [1, 1]
    words._KEPT.remove(keep)
