"""Token ids of whole texts with the tokenizers library, through a memo of words.

Where a vocabulary's pre-tokeniser drops white space (`drops_spaces`), no token crosses a
space or line feed, so a text's ids are the ids of its words in a row. Words repeat, so
the library sees each distinct word once per worker. A word of Latin letters with ASCII
punctuation behind it is given to the library's BPE model directly (lower-cased, in the
byte alphabet); any other word goes through the library's whole pipeline. With any other
vocabulary whole texts go through the library. `encode_all` takes several texts at once: their
words are split, told apart and trimmed by Arrow, so only distinct cores are looked up.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from saunter.llm.words import kept_by_worker, ragged

END_ID = 1
#: Entries after which a worker's memos of words and of cores begin a new generation: the last one is kept, and
#: what is asked for again moves on. Bounds their memory.
MEMO_WORDS, MEMO_CORES = 100_000, 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, int]:
    """The usual mapping of byte values to printable characters of byte-level BPE."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def drops_spaces(spec: dict) -> bool:
    """Whether a vocabulary's first pre-tokeniser keeps matches alone, and white space can't be in one."""
    first = spec["pre_tokenizer"] or {}
    first = first.get("pretokenizers", [first])[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = regex.compile(first["pattern"].get("Regex") or regex.escape(first["pattern"]["String"]))
    return not any(c in m[0] for c in " \n" for probe in (c, f"a{c}", f"{c}a", f"1{c}1", f"!{c}!") for m in pattern.finditer(probe))


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; missing words are encoded."""

    letters = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
    latin = "".join(filter(letters, map(chr, range(256))))
    #: Punctuation that may stand behind letters: ASCII's but the apostrophe, which begins tokens of its own.
    tail = string.punctuation.replace("'", "")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model, self.alphabet, self.cores = self.library.model, byte_alphabet(), {}
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # each core is asked for once: filling the model's cache costs more than it gives
        self.older: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        spec = json.load(open(path, encoding="utf-8"))
        kinds = {x.get("type") for x in [spec["normalizer"] or {}, *(spec["normalizer"] or {}).get("normalizers", [])]}
        self.spaced = drops_spaces(spec)
        self.direct = self.spaced and "Lowercase" in kinds and spec["model"].get("end_of_word_suffix") == "</w>"

    def _core(self, piece: str) -> bytes:
        if (ids := self.cores.get(piece)) is None:
            if (ids := self.older.get(piece)) is None:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
                ids = b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])
            self.cores[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older_words.get(word)) is None:
            core = word.rstrip(self.tail)
            if self.direct and (core.isalpha() if core.isascii() else self.letters(core)):
                low = core.lower()
                if (ids := self.cores.get(low)) is None:
                    ids = self._core(low)
                if len(core) < len(word):
                    end = word[len(core) :]
                    ids += self.cores.get(end) or self._core(end)
            else:
                ids = np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        return ids

    def _bound(self) -> None:
        if len(self) > MEMO_WORDS:
            self.older_words = dict(self)
            self.clear()
        if len(self.cores) > MEMO_CORES:
            self.older, self.cores = self.cores, {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, then the end id."""
        self._bound()
        if not self.spaced:
            return np.array([*self.library.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4").tobytes()
        words = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, words)) + END_ID.to_bytes(4, "little")

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts, as `encode` gives them, one behind another, and where each text's end."""
        if not self.direct:
            whole = [self.encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(whole), "<u4"), np.cumsum([len(x) // 4 for x in whole])
        self._bound()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        known = words.dictionary
        core, end = pc.utf8_rtrim(known, characters=self.tail), pc.utf8_ltrim(known, characters=self.latin)
        core_size, end_size, size = (pc.binary_length(x).to_numpy() for x in (core, end, known))
        plain = (core_size > 0) & (core_size + end_size == size)  # letters, then punctuation, and nothing else
        cores, ends = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode(), end.filter(pa.array(plain)).dictionary_encode()
        at = self.cores.get
        parts = [b"", END_ID.to_bytes(4, "little")]  # then what cores, ends and other words are made of
        parts += [at(x) or self._core(x) for x in cores.dictionary.to_numpy(zero_copy_only=False)]  # faster than to_pylist
        behind = len(parts)
        parts += [at(x) or self._core(x) if x else b"" for x in ends.dictionary.to_pylist()]
        others = len(parts)
        parts += map(self.__getitem__, known.filter(pa.array(~plain)).to_pylist())
        of = np.zeros((len(known), 2), np.int64)
        of[plain, 0], of[plain, 1] = 2 + cores.indices.to_numpy(), behind + ends.indices.to_numpy()
        of[~plain, 0] = others + np.arange(len(parts) - others)
        last = np.cumsum(pc.list_value_length(lists).to_numpy())
        order = np.insert(of[words.indices.to_numpy()].ravel(), 2 * last, 1)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])]
        return ids, np.cumsum(sizes[order])[2 * last + np.arange(len(last))]


@kept_by_worker
def encoder(path: str) -> WordEncoder:
    """One per Python worker: reused by the tasks that run there, until another operator's do."""
    return WordEncoder(path)
