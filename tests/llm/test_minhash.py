"""Near copies by sketches, against all pairs; sketches against their definition."""

import random

import numpy as np
import pytest

from saunter.llm import minhash
from saunter.llm.ngram_join import STEP
from saunter.llm.words import mixed
from tests.llm.test_pairs import table, words


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[top(k)] = min(best.get(top(k), i), i)
    return sorted((str(i), len(sets[k]), str(best.get(top(k), i) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def found(spark, texts, ids):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.sketch_components(table(spark, texts, ids)).collect())


def test_components_are_brute_force(spark):
    """Chains of near copies around the threshold, a group of near copies without a common link, short, empty, null and repeated texts."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(80)]
    texts = ["", None, " \n\t", "one", "ONE", "one two", "One  two", "é è é è é"]
    for k in range(30):
        base = [word() for _ in range(r.randint(3, 100))] + (passage if k % 3 == 0 else [])
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            for _ in range(r.randint(0, 2 + len(base) // 60)):
                base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
    for k in range(50):  # most pairs of these are just no links
        copy = [f"w{j}" for j in range(120)]
        for j in r.sample(range(120), 2 + k % 3):
            copy[j] = f"x{k}-{j}"
        texts.append(" ".join(copy))
    texts += [texts[9], texts[9], " ".join(f"long{k}" for k in range(30_000))]
    r.shuffle(texts)
    ids = [None if k == 12 else k * 3 % 1009 for k in range(len(texts) - 1)] + [27]
    assert found(spark, texts, ids) == brute(list(zip(ids, texts)))
    assert found(spark, [], []) == []


def plain_sketch(elements, bins):
    least = [None] * bins
    for i in range(2 * bins):
        for e in elements:
            h = int(mixed(np.array([e]) ^ mixed(np.array([i + 1], np.uint64) * STEP))[0])
            at, value = ((h >> 32) * bins >> 32 if i < bins else i - bins), i << 32 | h & 0xFFFFFFFF
            least[at] = value if least[at] is None else min(least[at], value)
        if None not in least:
            return least
    raise AssertionError("a bin is empty")


@pytest.mark.parametrize("n", [1, 2, 7, 40, 300])
def test_sketch_is_its_definition(n):
    elements = mixed(np.arange(1, n + 1, dtype=np.uint64))
    assert minhash.sketch(elements, 24).tolist() == plain_sketch(elements, 24)
    assert len(minhash.bands(minhash.sketch(elements))) == minhash.BINS // minhash.ROWS


def test_last_rounds_fill_every_bin(monkeypatch):
    """With bins that chance never draws."""
    monkeypatch.setattr(minhash, "mixed", lambda x: x & np.uint64(7))
    assert (minhash.sketch(np.arange(3, dtype=np.uint64), 16) >> np.uint64(32)).max() < 32


def test_agreement_is_concentrated():
    r = np.random.default_rng(1)
    share = []
    for _ in range(60):
        x = r.integers(0, 2**63, 600).astype(np.uint64)
        share.append(np.mean(minhash.sketch(x[:500]) == minhash.sketch(x[100:])))  # similarity 400 / 600
    assert abs(np.mean(share) - 2 / 3) < 0.015 and np.std(share) < 0.045
