"""The classifier's terms, cosines and votes again, in plain Python, and its boundary rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import documents
from tidemark.llm import quality

CLASSES = [" \t\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", None, ".?", ",;:", "!", "|/\\<>{}[]", "#$%&*@^~_=+"]


def terms(text):
    raw = text.encode()
    kinds = [5 if b > 127 else next((k for k, cs in enumerate(CLASSES) if cs and chr(b) in cs), 11) for b in raw]
    out = Counter((kinds[i] * 12 + kinds[i + 1]) * 12 + kinds[i + 2] for i in range(len(kinds) - 2))
    words, base = raw.split(), 12**3
    n = len(words)
    if n:
        again = sum(words[i] == words[i - 1] for i in range(1, n))
        symbols = sum(chr(w[-1]) in "!#$%&*|" for w in words)
        mean = sum(map(len, words)) / n
        for at, value in ((0, again), (1, sum(w.isupper() for w in words)), (2, symbols), (4 + min(9, int(again / n * 10)), n), (14 + min(9, int(len(set(words)) / n * 10)), n), (24 + min(7, int(mean / 2)), n), (32 + min(7, int(symbols / n * 8)), n)):
            out[base + at] += value
    return out


def unit(v):
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def brute_score(text, model):
    latent = [0.0] * model.basis.shape[1]
    weights = {t: math.log(1 + c) * float(model.idf[t]) for t, c in terms(text).items() if c}
    size = math.sqrt(sum(w * w for w in weights.values()))
    for t, w in weights.items():
        for j, b in enumerate(model.basis[t]):
            latent[j] += w / size * float(b)
    latent = unit(latent)
    cosines = sorted(((sum(a * float(b) for a, b in zip(latent, v)), k) for k, v in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
    votes = [(max(c, 0) ** quality.POWER * float(model.stands_for[k]), model.labels[k]) for c, k in cosines]
    total = sum(v for v, _ in votes)
    return sum(v * y for v, y in votes) / total if total else model.prior


def made(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        parts = [word().upper() if not good and rng.random() < 0.4 else word() + ("" if good or rng.random() < 0.5 else rng.choice(["!!", "|", "#1", "."])) for _ in range(rng.randint(5, 50))]
        rows.append((i, rng.choice([" ", "\n", ", "]).join(parts), "s"))
        labels.append((i, int(good)))
    return rows, labels


def test_votes_match_plain_python(spark):
    rows, labels = made(150)
    model = quality.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(spark, rows), model).collect()}
    for i, text, _ in rows[:80]:
        assert got[i] == pytest.approx(brute_score(text, model), abs=2e-3)


def test_learned_rows_do_not_depend_on_the_layout(spark):
    """Repeated ids, repeated and contradicting labels: the same model from any layout."""
    rows, labels = made(60)
    rows += [(i, t + " more words", "s") for i, t, _ in rows[:20]]
    labels += labels[:30] + [(1, 0), (2, None)]
    fits = [quality.fit(documents(spark, rows).repartition(k), spark.createDataFrame(labels, "doc_id long, quality int").repartition(k)) for k in (1, 5)]
    assert np.array_equal(fits[0].labels, fits[1].labels) and np.array_equal(fits[0].vectors, fits[1].vectors)


def test_a_very_long_text_is_scored_whole(spark):
    """Five MB of good prose with junk at its end score as the counts of all of it say."""
    rows, labels = made(120)
    good = next(t for i, t, _ in rows if i % 3)
    long = (good + " ") * (5_000_000 // len(good)) + "JUNK!! " * 200_000
    model = quality.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(spark, [(1, long, "s"), (2, long[:5_000_000], "s")]), model).collect()}
    direct = model.score([long.encode(), long[:5_000_000].encode()])
    assert [got[1], got[2]] == pytest.approx(list(direct)) and got[1] != got[2]
