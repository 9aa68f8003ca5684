"""Collocations against counts of every phrase in plain Python."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import phrases


def plain(rows, min_count, max_words=5, percent=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= min_count:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found[lang, p] = (a, left, right, totals[lang], score)
    kept = []
    for (lang, p), row in found.items():
        inside = [q for (g, q), other in found.items() if g == lang and len(q) > len(p) and 100 * other[0] >= percent * row[0] and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not inside:
            kept.append((lang, " ".join(p), *row))
    out = []
    for lang in {k[0] for k in kept}:
        own = sorted((k for k in kept if k[0] == lang), key=lambda k: (-k[6], -k[2], k[1].encode()))[:top]
        out += [(lang, i + 1, *k[1:]) for i, k in enumerate(own)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, 1, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, rank int, phrase string")


def made_rows():
    rng = random.Random(5)
    words = ["of", "the", "New", "york", "City", "hall", "é", "日本", "\x00", "a", "b", "c"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]
    rows = []
    for _ in range(120):
        parts = [w for _ in range(rng.randint(0, 60)) for w in (rng.choice(words) if rng.random() < 0.6 else "new york city hall", rng.choice(gaps))]
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(parts)))
    return [*rows, ("en", None), (None, ""), ("fr", " . "), ("en", "of the " * 2000), ("de", "alone"), *rows[:10]]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("min_count", [1, 3, 25])
def test_equals_plain_counts(spark, min_count):
    rows = made_rows()
    assert found(phrases.collocations(frame(spark, rows), min_count=min_count)) == plain(rows, min_count)


def test_percent_top_and_length(spark):
    rows = made_rows()
    got = phrases.collocations(frame(spark, rows), min_count=5, max_words=3, percent=80, top=7)
    assert found(got) == plain(rows, 5, 3, 80, 7)


def test_full_sketch_small_chunks_and_deep_tree_lose_nothing(spark, monkeypatch):
    rows = made_rows()
    want = plain(rows, 10)
    monkeypatch.setattr(phrases, "FAN", 2)
    got = phrases.collocations(frame(spark, rows).repartition(9), min_count=10, cells=64)  # every cell is full
    assert found(got) == want


def test_sketch_never_counts_too_little():
    rng = np.random.default_rng(1)
    texts = [b" ".join(f"w{i}".encode() for i in rng.integers(0, 40, 200)) for _ in range(20)]
    cells, limit = 1 << 10, 5
    whole = phrases.Words("en", texts)
    sums = [np.zeros(cells, np.int64) for _ in range(phrases.ROWS)]
    for text in texts:  # merged from one sketch a text
        for row, block, data in phrases.sketched([phrases.Words("en", [text])], 3, cells, limit):
            at, counts = phrases.unpacked(data)
            sums[row][at] = np.minimum(sums[row][at] + counts, limit)
    names = {n: c for ns, cs in phrases.survivors(whole, 3, cells, [np.packbits(s >= limit) for s in sums]) for n, c in zip(ns, cs.tolist(), strict=True)}
    counts = Counter(b" ".join(t.split()[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(201 - k))
    assert {n for n, c in counts.items() if c >= limit} <= names.keys()
    assert all(counts[n] == c for n, c in names.items())


def test_products_beyond_64_bits(spark):
    n, a, left, right = 10**13, 10**12 + 7, 10**12 + 11, 3 * 10**12 + 1
    known = spark.createDataFrame([("en", "", n), ("en", "x", left), ("en", "y", right), ("en", "x y", a)], "lang string, phrase string, n long")
    assert phrases.scored(known).first()["score"] == int(Fraction(1000 * a * n, left * right))


def test_empty_table_long_text_and_other_columns(spark):
    none = frame(spark, [("en", "a b")]).limit(0)
    assert phrases.collocations(none).collect() == []
    assert phrases.Words("en", [b" \t "]).total == 0
    rows = [("en", "the cat sat on the mat. " * 50_000), ("fr", " ")]
    assert found(phrases.collocations(frame(spark, rows))) == plain(rows, 100)
