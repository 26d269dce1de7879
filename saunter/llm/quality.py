"""Quality scores: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles; boosting goes round the features in turn and
fits a tree of four leaves to one feature's gradient histogram, so a feature's trees add up
to a lookup table. The pairs that most lower the loss then get tables of their own. A score
is the sum of the tables' entries through the logistic function.

Features are computed from whole texts in one pass over all documents and staged. Labels
are learned from at most ``max_train`` labelled rows, chosen by a hash of the id.

Defined results: null texts are empty and are scored like them; a null id is never held out
and never learned from; null labels are not learned from, several labels of a document are
several examples; without labels every score is 0.5; further columns are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saunter.llm.shared import crc_mod, staged
from saunter.llm.words import slices, utf8

FEATURES = ("chars", "words", "word_length", "upper", "digits", "marks", "distinct_words", "distinct_lines",
            "line_length", "repeats", "top_word", "short_words", "high_bytes", "stops", "long_words")
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 64, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 40, 0.1


def text_features(text: bytes) -> list[float]:
    """The values of FEATURES for one text in UTF-8."""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    upper, lower = count[65:91].sum(), count[97:123].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    tally = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return [np.log1p(len(text)), np.log1p(len(words)), sizes.mean() if len(words) else 0.0, upper / max(1, upper + lower), count[48:58].sum() / n,
            marks / n, len(tally) / m, len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)),
            sum(map(eq, words, words[1:])) / m, max(tally.values(), default=0) / m, (sizes <= 3).sum() / m, count[128:].sum() / n,
            count[46] / m, (sizes > 15).sum() / m]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FEATURES...) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 1):
            table = np.array([text_features(t) for t in utf8(b.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in np.ascontiguousarray(table.T))], names=["id", *FEATURES])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for k, edge in enumerate(self.edges):
            z += self.tables[k][np.searchsorted(edge, x[:, k], side="right")]
        for (a, b), table in self.pairs.items():
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best split of a histogram; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a tree with few leaves over a histogram of gradients and Hessians."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if not k:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A split on one axis, then one on the other axis in each half; with its gain."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            out, total = np.zeros_like(a), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                gr, hr = a[rows].sum(axis=0), b[rows].sum(axis=0)
                gain, k = _best_cut(gr, hr)
                total += gain + gr.sum() ** 2 / (hr.sum() + 1)
                for cols in (slice(0, k), slice(k, None)):
                    out[rows, cols] = -gr[cols].sum() / (hr[cols].sum() + 1)
            if total > best[0]:
                best = (total, out.T.copy() if flip else out)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n, width = x.shape
    edges = [_edges(x[:, k], BINS) for k in range(width)]
    coarse = [_edges(x[:, k], PAIR_BINS) for k in range(width)]
    fine = [np.searchsorted(edges[k], x[:, k], side="right") for k in range(width)]
    rough = [np.searchsorted(coarse[k], x[:, k], side="right") for k in range(width)]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(edges, coarse, float(np.log(p / (1 - p))), np.zeros((width, BINS)))
    z = np.full(n, model.bias)

    def slopes():
        q = 1 / (1 + np.exp(-z))
        return q - y, q * (1 - q)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(fine[k], g, BINS), np.bincount(fine[k], h, BINS))
            model.tables[k] += step
            z += step[fine[k]]
    g, h = slopes()
    cell = lambda a, b: rough[a] * PAIR_BINS + rough[b]
    grid = lambda a, b, v: np.bincount(cell(a, b), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = {(a, b): _pair_tree(grid(a, b, g), grid(a, b, h))[0] for a, b in itertools.combinations(range(width), 2)}
    for pair in sorted(gains, key=gains.get)[-PAIRS:]:
        model.pairs[pair] = np.zeros((PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in model.pairs.items():
            g, h = slopes()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            table += step
            z += step[rough[a], rough[b]]
    return model


def fit(scored: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> Model | None:
    """Trains on the labelled rows of staged `features`; None without a label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    n = known.count()
    drawn = F.xxhash64("id").bitwiseAND((1 << 30) - 1)
    known = known.where(drawn < int(min(1.0, max_train / max(1, n)) * (1 << 30))).orderBy(drawn).limit(2 * max_train)
    rows = scored.join(known, "id").orderBy("id").select(*FEATURES, "y").toPandas()
    return train(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy()) if len(rows) else None


def score(scored: DataFrame, model: Model | None) -> DataFrame:
    """(id, score) of staged `features`: sums of table entries, all rows of a batch at once."""
    kind = scored.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.stack([b.column(f).to_numpy() for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=["id", "score"])

    return scored.mapInArrow(run, f"id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_mod: int = 3, held_out_rest: int = 1,
             id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Labels of held-out rows are never learned from."""
    scored = staged(features(docs, id_col, text_col))
    held = lambda c: F.coalesce(crc_mod(c, held_out_mod) == held_out_rest, F.lit(False))
    model = fit(scored, labels.where(~held(id_col)), label_col, id_col, max_train)
    found = score(scored, model)
    return found.select(F.col("id").alias(id_col), held("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
