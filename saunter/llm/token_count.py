"""Token counts by linear longest match: word-piece lengths without building the pieces.

The vocabulary is one of word-initial pieces (marked by a leading U+2581) and continuations.
Both go into a trie; each node gets a failure link and the number of tokens that following
it completes, so a word is counted in one pass over its characters, however its greedy
longest matches fall.

A word is a run of characters other than white space. A word that no sequence of pieces
makes counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; repeated rows and null
ids get a row each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from saunter.llm.words import slices

MARK = "▁"
MEMO_WORDS = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    special = lambda i: p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not special(i)]


class Automaton(dict):
    """word -> 2 * tokens, plus 1 if it is unknown; missing words are counted.

    Nodes are numbers: 0 is the root of word-initial pieces, 1 that of continuations.
    """

    def __init__(self, pieces: list[str]):
        super().__init__()
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for piece in pieces:
            at = 0 if piece.startswith(MARK) else 1
            if MARK in piece[1:]:
                continue
            for c in piece:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    final.append(False)
                at = self.child[at][c]
            final[at] = True
        self.fail: list[int | None] = [None] * len(self.child)
        self.pops = [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    if final[v]:
                        self.fail[v], self.pops[v] = 1, 1
                    else:
                        z, n = self.fail[u], self.pops[u]
                        while z is not None and c not in self.child[z]:
                            n += self.pops[z]
                            z = self.fail[z]
                        if z is not None:
                            self.fail[v], self.pops[v] = self.child[z][c], n
                    below.append(v)
            level = below

    def count(self, word: str) -> int | None:
        """How many pieces the greedy longest matches of a word are; None if they don't cover it."""
        at, n = 0, 0
        for c in MARK + word:
            while c not in self.child[at]:
                if self.fail[at] is None:
                    return None
                n += self.pops[at]
                at = self.fail[at]
            at = self.child[at][c]
        while at != 1:
            if self.fail[at] is None:
                return None
            n += self.pops[at]
            at = self.fail[at]
        return n

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        value = self[word] = 3 if n is None else 2 * n
        return value


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(read_pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, n_unknown."""
    path, kind = vocabulary or default_vocabulary(), docs.schema[id_col].dataType.simpleString()

    def run(batches):
        words = automaton(path)
        for b in slices(batches, 1):
            out = np.zeros((3, b.num_rows), np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                if len(words) > MEMO_WORDS:
                    words.clear()
                found = (text or "").split()
                values = np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found))
                out[:, i] = len(found), (values >> 1).sum(), (values & 1).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
