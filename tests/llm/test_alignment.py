"""Links between two tokenizers' ids, against plain loops over bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from saunter.llm import alignment
from saunter.llm.tokens import byte_alphabet
from tests.llm.test_pairs import table

PATHS = alignment.default_vocabularies()
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=PATHS[1])
BACK = {chr(c): b for b, c in byte_alphabet().items()}


def tokens(text):
    """[(id, bytes)] of either side, or two empty lists."""
    if not text:
        return [], []
    a = [(i, bytes(BACK[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(side):
    out, at = [], 0
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows):
    linked, shown = [], []
    for _, text in rows:
        a, b = map(spans, tokens(text))
        linked.append([(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)])
        groups, at = [], 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= end) for side in (a, b)))
            at = end
        shown.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return sorted(str((d, x, y, g, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha))
                  for (d, _), links, (x, y, g, sha) in zip(rows, linked, shown))


TEXTS = ["", None, "hello world", "Hello  world ", " lead", "<s> <|endoftext|> <unk> <0x41>", "x▁y", "two\n\n\ttabs \x00 z", "é😀 中文字 ñandú", "naïve café", "a" * 3000,
         "don't isn't 1234567 3.14", "​﻿ ", "the cat sat on the mat and the dog sat on the log " * 40, "hello world", "straße über Größe"]


@pytest.mark.parametrize("chunk", [1, 1000, 4 << 20])
def test_report_is_brute_force(spark, chunk):
    """With a chunk per text, several and one."""
    ids = [*range(len(TEXTS) - 2), 3, None]
    got = alignment.link_report(table(spark, TEXTS, ids), chunk_bytes=chunk)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(list(zip(ids, TEXTS)))


def test_groups_and_empty_table(spark):
    docs = table(spark, TEXTS)
    for r in alignment.aligned_groups(docs).collect():
        a, b = tokens(TEXTS[r["doc_id"]])
        assert [i for g in r["groups"] for i in g["a"]] == [i for i, _ in a] and [i for g in r["groups"] for i in g["b"]] == [i for i, _ in b]
    assert alignment.link_report(docs.limit(0)).count() == 0 and alignment.aligned_groups(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab \n'é1<|>_s", max_size=80))
def test_ids_are_the_libraries(text):
    a, b = alignment._sides(*PATHS)
    assert a[0](" " + text) == A.encode(" " + text, add_special_tokens=False).ids and b[0](text) == B.encode(text)
    one = alignment.Aligned(text, a, b)
    x, y = map(spans, tokens(text))
    assert sorted((i << 32 | j) for i, s, e in x for j, t, f in y if max(s, t) < min(e, f)) == sorted(one.keys.tolist())


def test_library_where_ids_are_no_ranks(tmp_path):
    """A vocabulary whose pre-tokeniser differs is left to the library."""
    path = tmp_path / "other.json"
    path.write_text(open(PATHS[0], encoding="utf-8").read().replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))
    other = alignment.ByteLevel(str(path))
    assert type(getattr(other.ids, "__self__", None)).__name__ != "Encoding" and other.ids(" hello") == A.encode(" hello", add_special_tokens=False).ids
    assert public_tokenizers.PATTERN


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(max_size=40) | st.text(alphabet="ab \n\t\x1f\xa0'é1▁.,", max_size=60), max_size=6))
def test_stretches_are_whole_texts(texts):
    """What is put together from stretches is what a whole text gives, whatever was seen and forgotten before."""
    known = alignment.stretches(*PATHS)
    for text, numbers in zip(texts, known.of(texts)):
        one = alignment.Aligned(text, known.a, known.b)
        assert known.counts[numbers].sum(0).tolist() == [len(one.a), len(one.b), len(one.cut_a), len(one.keys)]
        assert b";".join(known.shown[k] for k in numbers) == ";".join(one.shown(known.a[3], known.b[3])).encode()
        assert [k for x in numbers for k in known.keys[known.firsts[x] : known.firsts[x] + known.counts[x, 3]].tolist()] == one.keys.tolist()


def test_a_stretch_is_encoded_once(monkeypatch):
    """Repeated words cost no further call of a library; the most used ones are kept, within the bounds."""
    monkeypatch.setattr(alignment, "KEPT_STRETCHES", 4)
    known, sent = alignment.Stretches(*PATHS), []
    encode = known.a[0]
    known.a = (lambda text: sent.append(text) or encode(text), *known.a[1:])
    known.of(["the cat sat on the mat " * 50, None, "the cat"])
    assert sum(map(len, sent)) < 60
    known.trim()
    assert len(known.numbers) == len(known.shown) == 2 and "the" in known.numbers
    sent.clear()
    assert len(known.of(["the cat and the dog"])[0]) == 5 and "the" not in " ".join(sent).split()


def test_vocabularies_that_reach_over_spaces_get_whole_texts(tmp_path):
    path = tmp_path / "other.json"
    path.write_text(open(PATHS[0], encoding="utf-8").read().replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'))
    known = alignment.Stretches(str(path), PATHS[1])
    assert not known.apart and alignment.Stretches(*PATHS).apart
    one = alignment.Aligned("the cat sat", known.a, known.b)
    assert [len(x) for x in known.of(["the cat sat"])] == [1] and known.counts[0, 0] == len(one.a)
