"""Links between the tokens of two tokenizers, and how usual each pair of linked ids is in the corpus.

Both encode the same bytes. Ends that both sides' tokens have slice both id lists into groups. Within a slice each stretch
between neighbouring ends of either side lies in one token of each: it is one link.

Where no token of either side reaches over a space behind another character (``apart``), a text's tokens, groups and links are
those of its stretches from one such space to the next. Stretches repeat, so a worker aligns each distinct one once and keeps what
it found of the most used ones (`Stretches`); new ones are joined and aligned together. With other vocabularies a text is one stretch.

1. One pass encodes and aligns. Texts are taken together in chunks of about ``CHUNK_BYTES``: a chunk is one row with the
   distinct id pairs of its texts, in how many of them each is, and the pairs of each text as numbers into that list. A
   pair that a third of all texts hold is a row per chunk, not per text.
2. Pairs are counted over all chunks, and per first id the highest count is found: aggregations of fixed-width rows.
3. Counts go back to the chunks that asked for them, and each text's sums are made there.

Defined results: a text that is null or empty, or whose tokens' bytes differ from a space and the text (as a text that holds
the mark of the second vocabulary), has no tokens: zeros and an empty group list; a very long text is a chunk of its own; null
and repeated ids get a row each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.shared import Scratch
from saunter.llm.tokens import byte_alphabet
from saunter.llm.words import Numbers, kept_by_worker, ragged, slices

#: Text that is taken together: bounds what a task holds and the size of a chunk's row.
CHUNK_BYTES = 4 << 20
#: Stretches that a worker keeps between chunks, their bytes with those of their groups as text, and how many are aligned together.
KEPT_STRETCHES, KEPT_BYTES, TOGETHER = 200_000, 32 << 20, 20_000
REPORT = ["n_a", "n_b", "n_groups", "n_links"]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """A byte-level BPE vocabulary: ids of a text, and each id's bytes. Its special tokens in a text are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec, back = json.load(open(path, encoding="utf-8")), {chr(c): b for b, c in byte_alphabet().items()}
        vocabulary = {k: i for k, i in spec["model"]["vocab"].items() if k not in {t["content"] for t in spec["added_tokens"]}}
        raw = lambda shown: bytes(map(back.__getitem__, shown))
        self.bytes = {i: raw(k) for k, i in vocabulary.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in pairs]
        kept = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.apart = kept and spec["normalizer"] is None and made == sorted(set(made)) and min(made, default=256) >= 256 and len(self.bytes) == 256 + len(made)
        if self.apart:
            # Where ids are merge ranks, the faster library of ranks gives the same ids.
            import public_tokenizers

            self.ids = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={}).encode_ordinary
        else:
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.ids = lambda text: library.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece vocabulary: its mark is a space, and its byte pieces are bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        p, spec = SentencePieceProcessor(model_file=path), sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(p.serialized_model_proto())
        rules, names = spec.normalizer_spec, [x.piece for x in spec.pieces]
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        self.apart = plain and spec.trainer_spec.model_type == spec.trainer_spec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix and not any("▁" in x.lstrip("▁") for x in names)
        shown = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = {i: shown(i) for i in range(p.get_piece_size())}
        self.ids = lambda text: p.encode(text, num_threads=1)


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str):
    """Either side's encoder; by id, lengths, bytes and names; and whether its tokens stay apart at spaces. One per Python worker."""
    def side(v):
        most = max(v.bytes) + 1
        return v.ids, np.array([len(v.bytes.get(i, b"")) for i in range(most)], np.int64), v.bytes, list(map(str, range(most))), v.apart

    return side(ByteLevel(path_a)), side(Pieces(path_b))


class Aligned:
    """A text's ids on both sides, where their tokens end, and the places where groups end: ``cut_a[k]``, ``cut_b[k]`` tokens are in the
    first k + 1 groups. ``ends`` are those of links, ``keys`` their pairs."""

    def __init__(self, text: str | None, a, b):
        self.a, self.b, self.cut_a, self.cut_b = [], [], [], []
        self.ends_a = self.ends_b = self.ends = self.keys = np.zeros(0, np.int64)
        if not text:
            return
        want, ids_a, ids_b = b" " + text.encode(), a[0](" " + text), b[0](text)
        if b"".join(map(a[2].__getitem__, ids_a)) != want or b"".join(map(b[2].__getitem__, ids_b)) != want:
            return
        self.a, self.b = ids_a, ids_b
        left, right = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        self.ends_a, self.ends_b = np.cumsum(a[1][left]), np.cumsum(b[1][right])
        at = np.searchsorted(self.ends_b, self.ends_a)
        both = self.ends_b[at] == self.ends_a
        self.cut_a, self.cut_b = (np.flatnonzero(both) + 1).tolist(), (at[both] + 1).tolist()
        self.ends = np.union1d(self.ends_a, self.ends_b)
        self.keys = left[np.searchsorted(self.ends_a, self.ends)] << 32 | right[np.searchsorted(self.ends_b, self.ends)]

    def groups(self):
        """(ids of a, ids of b) per group."""
        i = j = 0
        for x, y in zip(self.cut_a, self.cut_b):
            yield self.a[i:x], self.b[j:y]
            i, j = x, y

    def shown(self, names_a: list[str], names_b: list[str]) -> list[str]:
        """Each group as ``a1,a2|b1``."""
        a, b, out, i, j = list(map(names_a.__getitem__, self.a)), list(map(names_b.__getitem__, self.b)), [], 0, 0
        for x, y in zip(self.cut_a, self.cut_b):
            out.append(f"{a[i]}|{b[j]}" if x - i == y - j == 1 else f"{','.join(a[i:x])}|{','.join(b[j:y])}")
            i, j = x, y
        return out


class Stretches:
    """What is known of stretches of text, by their numbers: their groups as text (none: the bytes differ), how many tokens, groups
    and links they have (``counts``), and where their links' pairs are in ``keys``."""

    cut = re.compile(r"(?s)(?<=\S) (?=.)").split

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _sides(path_a, path_b)
        self.apart = self.a[4] and self.b[4]
        self.numbers, self.shown = Numbers(), []
        self.counts, self.firsts, self.keys = np.zeros((0, len(REPORT)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's stretches, none for a text without tokens; what is new among them is aligned."""
        found = [self.numbers.of((self.cut(t) if self.apart else [t]) if t else []) for t in texts]
        new = list(islice(self.numbers, len(self.shown), None))
        for k in range(0, len(new), TOGETHER):
            self._learn(new[k : k + TOGETHER])
        wrong = np.array([x is None for x in self.shown], bool)
        found = [x[:0] if wrong[x].any() else x for x in found]
        self.uses = self.uses + np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=len(self.uses))
        return found

    def _learn(self, new: list[str]) -> None:
        joint = [self.apart and "▁" not in x and not x[-1].isspace() for x in new]
        some = [x for x, j in zip(new, joint) if j]
        found = iter(self._together(some) or map(self._alone, some))
        rows = [next(found) if j else self._alone(x) for x, j in zip(new, joint)]
        self.shown += [shown for shown, _, _ in rows]
        self.counts = np.concatenate([self.counts, np.array([n for _, n, _ in rows], np.int64)])
        sizes = self.counts[len(self.firsts) :, 3]
        self.firsts = np.concatenate([self.firsts, len(self.keys) + np.cumsum(sizes) - sizes])
        self.keys = np.concatenate([self.keys, *(keys for *_, keys in rows)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.bytes = np.concatenate([self.bytes, np.array([len(x) + len(shown or b"") for x, (shown, _, _) in zip(new, rows)], np.int64)])

    def _alone(self, stretch: str):
        one = Aligned(stretch, self.a, self.b)
        return ";".join(one.shown(self.a[3], self.b[3])).encode() if one.a else None, (len(one.a), len(one.b), len(one.cut_a), len(one.keys)), one.keys

    def _together(self, some: list[str]):
        """What `_alone` gives for each; None if they don't come apart again."""
        one, ends = Aligned(" ".join(some), self.a, self.b), np.cumsum([len(x.encode()) + 1 for x in some])
        sides = (one.ends_a, one.ends_b, one.ends_a[np.array(one.cut_a, np.int64) - 1], one.ends) if one.a else ()
        if not sides or not all(np.isin(ends, x).all() for x in sides[:2]):
            return None
        upto = np.array([np.searchsorted(x, ends) + 1 for x in sides]).T
        counts, groups = np.diff(upto, axis=0, prepend=0), one.shown(self.a[3], self.b[3])
        shown = [";".join(groups[j - n : j]).encode() for j, n in zip(upto[:, 2].tolist(), counts[:, 2].tolist())]
        return zip(shown, counts.tolist(), np.split(one.keys, upto[:-1, 3]))

    def trim(self) -> None:
        """Keeps the most used stretches, if there are more than the bounds allow."""
        if len(self.shown) <= KEPT_STRETCHES and self.bytes.sum() <= KEPT_BYTES:
            return
        most = np.argsort(-self.uses, kind="stable")[: KEPT_STRETCHES // 2]
        kept = np.sort(most[np.cumsum(self.bytes[most]) <= KEPT_BYTES // 2])
        names, self.numbers, self.shown = list(self.numbers), Numbers(), [self.shown[k] for k in kept.tolist()]
        self.numbers.of([names[k] for k in kept.tolist()])
        sizes = self.counts[kept, 3]
        self.keys, self.firsts = self.keys[ragged(self.firsts[kept], sizes)], np.cumsum(sizes) - sizes
        self.counts, self.uses, self.bytes = self.counts[kept], self.uses[kept] // 2, self.bytes[kept]


@kept_by_worker
def stretches(path_a: str, path_b: str) -> Stretches:
    """One per Python worker."""
    return Stretches(path_a, path_b)


def aligned_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(id, groups): per row the groups of ids that cover the same bytes; empty without tokens. Map only."""
    paths, kind = vocabularies or default_vocabularies(), docs.schema[id_col].dataType.simpleString()
    group = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches):
        a, b = _sides(*paths)
        for part in slices(batches, 1):
            found = [[{"a": x, "b": y} for x, y in Aligned(t, a, b).groups()] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, group)], names=["id", "groups"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, groups array<struct<a: array<int>, b: array<int>>>").withColumnRenamed("id", id_col)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by their bytes' places, packed: small ones take little."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _chunks(docs: DataFrame, id_type: str, paths: tuple[str, str], most: int) -> DataFrame:
    """A row per chunk: ids, REPORT and group digests of its texts; its distinct pairs and the number of texts with each; and each
    text's pairs, as steps between ascending numbers into that list, with their multiplicities."""
    ddl = f"chunk long, ids array<{id_type}>, " + ", ".join(f"{k} array<long>" for k in REPORT) + ", digests array<string>, pairs array<long>, texts array<int>, sizes array<int>, steps binary, times binary"

    def run(batches):
        known, chunk = stretches(*paths), TaskContext.get().partitionId() << 40
        for part in slices(batches, 1, most, own=stretches):
            found = known.of(part.column(1).to_pylist())
            cols = np.array([known.counts[x].sum(0) for x in found]).T
            digests = [hashlib.sha256(b";".join(map(known.shown.__getitem__, x.tolist()))).hexdigest() if len(x) else "" for x in found]
            flat = np.concatenate(found)
            links = ragged(known.firsts[flat], known.counts[flat, 3])
            used = np.zeros(len(known.keys), bool)
            used[links] = True
            pairs, place = np.unique(known.keys[used], return_inverse=True)
            number = np.zeros(len(known.keys), np.int64)
            number[used] = place
            order = np.argsort(-np.bincount(number[links], minlength=len(pairs)), kind="stable")  # usual pairs get small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            asked, times = np.unique(np.repeat(np.arange(len(found)), cols[3]) << 32 | rank[number[links]], return_counts=True)
            held = np.bincount(asked & 0xFFFFFFFF, minlength=len(pairs))
            sizes = np.bincount(asked >> 32, minlength=len(found))
            steps = np.diff(asked, prepend=0)
            firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
            steps[firsts] = asked[firsts] & 0xFFFFFFFF
            known.trim()
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), *(one(c, pa.int64()) for c in cols), one(digests, pa.string()),
                 one(pairs[order], pa.int64()), one(held, pa.int32()), one(sizes, pa.int32()), pa.array([_planes(steps)], pa.binary()), pa.array([_planes(times)], pa.binary())],
                names=["chunk", "ids", *REPORT, "digests", "pairs", "texts", "sizes", "steps", "times"])
            chunk += 1

    return docs.mapInArrow(run, ddl)


def _summed(chunks: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of one chunk's texts, with n_best and count_sum by the counts of its pairs (place, n, best)."""
    c = chunks.to_pylist()[0]
    of, best = np.zeros(c["n_pairs"], np.int64), np.zeros(c["n_pairs"], np.int64)
    place = counts.column("place").to_numpy()
    of[place], best[place] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    sizes = np.array(c["sizes"], np.int64)
    ends = np.cumsum(sizes)
    steps, times = _unplaned(c["steps"], ends[-1]), _unplaned(c["times"], ends[-1])
    # A text's numbers are its steps' sums since its first.
    at = np.cumsum(steps)
    before = np.concatenate([[0], at])[ends - sizes]
    at -= np.repeat(before, sizes)
    sums = [np.diff(np.concatenate([[0], np.cumsum(x[at] * times)])[np.concatenate([[0], ends])]) for x in (best, of)]
    kind = chunks.schema.field("ids").type.value_type
    return pa.table([pa.array(c["ids"], kind), *(pa.array(c[k], pa.int64()) for k in REPORT), *map(pa.array, sums), pa.array(c["digests"], pa.string())],
                    names=["id", *REPORT, "n_best", "count_sum", "groups_sha256"])


def link_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the most usual of its first id),
    count_sum (over links, of the texts that hold the pair) and groups_sha256 (of the groups as text)."""
    stage, kind = Scratch(docs.sparkSession), docs.schema[id_col].dataType.simpleString()
    chunks = stage(_chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kind, vocabularies or default_vocabularies(), chunk_bytes))
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    counts = stage(held.groupBy("pair").agg(F.sum("texts").alias("n")).withColumn("first", F.shiftright("pair", 32)))
    most = counts.groupBy("first").agg(F.max("n").alias("most"))
    judged = counts.join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    asked = held.select("chunk", "place", "pair").join(judged, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    out = f"id {kind}, " + ", ".join(f"{k} long" for k in [*REPORT, "n_best", "count_sum"]) + ", groups_sha256 string"
    slim = chunks.select("chunk", "ids", *REPORT, "digests", F.size("pairs").alias("n_pairs"), "sizes", "steps", "times")
    found = slim.groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(_summed, out)
    return stage.result(found).withColumnRenamed("id", id_col)
