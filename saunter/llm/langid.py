"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: 1- to 3-grams of letters within words (a space at either end), hashed into
``BUCKETS``. A feature is (share of the text's n-grams) * idf, which makes a text's scores a
sum over its words, so each distinct word's n-grams are looked up once per task.

* idf comes from all training documents: a pass over their whole texts.
* Weights come from at most ``max_train`` labelled documents, about as many of each
  language, chosen by a hash of the id; training is follow-the-regularised-leader (proximal)
  with L1 and L2 penalties, on the driver.
* A temperature, fitted on every fifth of these (not trained on), calibrates the scores.

Defined results: null texts and texts without a letter are `und` with score 0; a null id is
never held out and never trained on; repeated rows are predicted alike; rows with a null
language are predicted only; without any training row every document is `und`; further
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saunter.llm.shared import crc_mod, map_whole_rows
from saunter.llm.words import Numbers, released, slices

BUCKETS, LONGEST = 1 << 16, 3
MAX_TRAIN = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.02, 0.05
SCALE = 100.0
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none for a text without a letter."""
    words = LETTERS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


class Grams(Numbers):
    """Numbers words, and keeps each word's n-gram buckets in one flat array."""

    def __init__(self):
        super().__init__()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        known = len(self)
        numbers = self.of(words)
        if len(self) > known:
            self._extend(list(self)[known:])
        return numbers

    def _extend(self, new: list[str]) -> None:
        chars = np.frombuffer(("\0 " + " \0 ".join(new) + " \0").encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.cumsum(chars == 0) - 1
        found_bucket, found_word = [], []
        with np.errstate(over="ignore"):
            for n in range(1, LONGEST + 1):
                h, whole = np.full(len(chars) - n + 1, np.uint64(n)), np.ones(len(chars) - n + 1, bool)
                for k in range(n):
                    part = chars[k : len(chars) - n + 1 + k]
                    h, whole = h * np.uint64(0x9E3779B97F4A7C15) + part, whole & (part != 0)
                h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                found_bucket.append((h >> np.uint64(40)).astype(np.int64)[whole] % BUCKETS)
                found_word.append(word[: len(h)][whole])
        bucket, of = np.concatenate(found_bucket), np.concatenate(found_word)
        self.flat = np.concatenate([self.flat, bucket[np.argsort(of, kind="stable")].astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])

    def buckets(self, numbers: np.ndarray) -> np.ndarray:
        """The n-gram buckets of these words, one after another."""
        first, n = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        skip = np.repeat(first - (np.cumsum(n) - n), n)
        return self.flat[np.arange(len(skip)) + skip]


MEMO_WORDS = 100_000


def _grams(batches, text_col: str = "text"):
    """Runs of rows with their texts' words, all looked up; the memo is emptied when it gets large."""
    memo = Grams()
    for b in slices(batches, text_col):
        texts = [letter_words(t) for t in b.column(text_col).to_pylist()]
        if len(memo) > MEMO_WORDS:
            memo = Grams()
        memo.look_up(list(chain.from_iterable(texts)))
        yield b, memo, texts


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bucket, n): how many texts hold each bucket's n-grams."""
    def count(batches):
        total, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.uint8)
        for _, memo, texts in _grams(batches):
            for words in texts:
                held = memo.buckets(memo.look_up(list(set(words))))
                seen[held] = 1
                total += seen
                seen[held] = 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def features(docs: DataFrame) -> DataFrame:
    """(lang, buckets, counts): n-gram counts of each text."""
    def run(batches):
        for b, memo, texts in _grams(batches):
            held = [np.unique(memo.buckets(memo.look_up(words)), return_counts=True) for words in texts]
            yield pa.RecordBatch.from_arrays([b.column("lang"), *(pa.array([h[k].astype(np.int32) for h in held], pa.list_(pa.int32())) for k in (0, 1))], names=["lang", "buckets", "counts"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, buckets array<int>, counts array<int>")


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, times idf and scale, in 32 bits
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Follow the regularised leader, proximal, per coordinate; then the temperature."""
    languages = sorted({x[0] for x in examples})
    rows = [(languages.index(lang), np.append(b, np.int32(BUCKETS)), np.append(c / c.sum() * idf[b] * SCALE, 1.0)) for lang, b, c in examples if len(b)]
    fit, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    fit = fit or rows
    z, n = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            y, b, x = fit[i]
            zb, nb = z[b], n[b]
            w = weights(zb, nb)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA
            z[b], n[b] = zb + g - step * w, nb + g * g
    w = weights(z, n)
    model = Model(languages, (w[:-1] * (idf * SCALE)[:, None]).astype(np.float32), w[-1])
    if held:
        logits, ys = np.array([x @ w[b] for _, b, x in held]), np.array([y for y, _, _ in held])

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(ys)), ys], 1e-12)).mean()

        model.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Trains on (id, text, lang) rows; None if no language is known."""
    known = docs.where("lang is not null and id is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    found = document_frequencies(known).toArrow()  # BUCKETS rows at most
    idf = np.full(BUCKETS, np.log(1 + sum(sizes.values())))
    idf[found["bucket"].to_numpy()] -= np.log(1 + found["n"].to_numpy())
    idf += 1
    each = max(1, max_train // len(sizes))
    drawn = F.xxhash64("id").bitwiseAND((1 << 30) - 1)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / n) * (1 << 30)))))
    sample = features(known.where(drawn < share[F.col("lang")]).orderBy(drawn).limit(2 * max_train))
    rows = [(r["lang"], np.array(r["buckets"], np.int32), np.array(r["counts"], np.int32)) for r in sample.toLocalIterator()]
    try:
        return train(rows, idf)
    finally:
        del rows
        released()  # else the driver would keep the examples' memory for the rest of its life


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns of ``docs`` with the predicted language and its score behind them, under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def run(batches):
        m = shared.value
        for b, memo, texts in _grams(batches, text_col):
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, words in enumerate(texts) if words]
            if some and m is not None:
                numbers = memo.look_up([w for i in some for w in texts[i]])
                used, at = np.unique(numbers, return_inverse=True)
                sizes = memo.ends[used + 1] - memo.ends[used]
                starts = np.cumsum(sizes) - sizes
                per_word = np.add.reduceat(m.weights[memo.buckets(used)], starts, axis=0, dtype=np.float64)
                first = np.cumsum([0, *(len(texts[i]) for i in some)])[:-1]
                total = np.add.reduceat(sizes[at], first)
                p = m.probabilities(np.add.reduceat(per_word[at], first, axis=0) / total[:, None] + m.bias)
                for i, best, s in zip(some, p.argmax(axis=1), p.max(axis=1)):
                    pred[i], score[i] = m.languages[best], s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names, *names])

    return map_whole_rows(docs, run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN,
          names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score (in place of columns of these names), by a model of its own labelled rows."""
    docs = docs.drop(*names)
    return predict(docs, fit(_training_rows(docs, id_col, text_col, lang_col), max_train), text_col, names)


def identify(docs: DataFrame, held_out_mod: int = 5, held_out_rest: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score. Held-out rows are never learned from."""
    rows = _training_rows(docs, id_col, text_col, lang_col)
    held = F.coalesce(crc_mod("id", held_out_mod) == held_out_rest, F.lit(False))
    found = predict(rows.select("id", "text"), fit(rows.where(~held), max_train))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
