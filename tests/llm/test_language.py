"""Language by rank-order profiles: plain-Python version, held-out accuracy, odd rows."""

import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_oracles import DATA
from tidemark.llm import language


def plain_ranks(counts, size):
    """n-gram to mean rank, of the ``size`` most frequent."""
    order = sorted(counts, key=lambda g: (-counts[g], [len(g), *map(ord, g)]))[:size]
    places = {}
    for i, g in enumerate(order):
        places.setdefault(counts[g], []).append(i)
    return {g: sum(places[counts[g]]) / len(places[counts[g]]) for g in order}


def plain_counts(text):
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        found.update(word)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    # Words next to each other share a space, and every n-gram begins and ends a word once.
    return found


def plain_predict(text, profiles, depth, profile):
    counts = plain_counts(text or "")
    if not counts or not profiles:
        return "und", 0.0
    own = plain_ranks(counts, profile)
    stretch = profile / len(own)
    away = {k: sum(min(depth, abs(r[g] - own[g] * stretch)) if g in r else depth for g in own) / len(own) / depth for k, r in profiles.items()}
    best = min(sorted(away), key=lambda k: away[k])
    return best, 1 - away[best]


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


TEXTS = [
    ("the cat sat on the mat, and then the other cat ran away from the house", "en"),
    ("when the rain came they went to the barn with all of their things", "en"),
    ("le chat est sur la table et les enfants sont dans le jardin avec lui", "fr"),
    ("quand la pluie est venue ils sont allés à la maison pour manger", "fr"),
    ("der Hund läuft über die Straße und die Kinder spielen im Garten", "de"),
]


def test_equals_plain_python(spark):
    rows = [(i, TEXTS[i % 5][0] + f" {i} " * (i % 3), TEXTS[i % 5][1]) for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (102, "1234 ... !", "fr"), (103, "Über", None), (104, "İstanbul Ünïcödé 北京大学", None), (None, "the cat", "xx"), (105, "la " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for depth, profile in ((60, 30), (language.DEPTH, language.PROFILE)):
        counts = {}
        for i, text, lang in rows:
            if i is not None and lang and learned(i):
                counts.setdefault(lang, Counter()).update(plain_counts(text or ""))
        profiles = {k: plain_ranks(c, depth) for k, c in counts.items() if c}
        got = language.identify(docs, language.fit(docs, depth=depth, profile=profile), keep=["doc_id"]).collect()
        want = sorted((str(i), *plain_predict(text, profiles, depth, profile)) for i, text, _ in rows if i != 104)
        got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in got if r["doc_id"] != 104)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-6)
        assert dict((r[0], r[1]) for r in got)["102"] == "und"


def test_nothing_learned_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(0, "abc", None, 3.0, "x"), (1, None, None, 4.0, "y")], "doc_id long, text string, lang string, score double, lang_pred string")
    found = language.identify(docs, language.fit(docs))
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {(r["lang_pred"], r["score"]) for r in found.collect()} == {("und", 0.0)}
    none = docs.limit(0)
    assert language.identify(none, language.fit(none)).count() == 0


def test_lang_of_a_held_out_row_and_many_languages(spark):
    docs = spark.createDataFrame([(i, t, lang if learned(i) else "zz") for i, (t, lang) in enumerate(TEXTS * 4)], "doc_id long, text string, lang string")
    assert "zz" not in language.fit(docs).languages
    many = spark.range(1000).selectExpr("id as doc_id", "'abc' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="languages"):
        language.fit(many)


def test_long_text_and_bytes_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(i, bytearray(t.encode()), lang) for i, (t, lang) in enumerate(TEXTS * 4)], "doc_id long, text binary, lang string")
    odd = spark.createDataFrame([(1, bytearray(b"le chat \xff\xfe est sur la table")), (2, bytearray(("der Hund und die Kinder " * 80_000).encode()))], "doc_id long, text binary")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, language.fit(docs)).collect()}
    assert got == {1: "fr", 2: "de"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.identify(docs, language.fit(docs)).where(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right = found.where("lang_pred = lang").count()
    assert right >= 0.98 * found.count() > 0
