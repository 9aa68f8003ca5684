"""Every operator on empty tables and on very long texts."""

import hashlib
import zlib

import pytest

from tidemark.llm import decontaminate, exact, lpf, mixing, pii, quality, sharding, simhash, templates, url_lists

LONG = "Words of one line, again and again. " * 40_000  # 1.4 million characters


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, LONG, "a"), (3, "x", "b"), (4, None, None), (5, "", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([("i", "some words of an item")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    empty = [
        lpf.remove_repeats(none),
        decontaminate.decontaminate(none, items),
        exact.exact_duplicates(none),
        sharding.shard(none),
        mixing.mix(none),
        templates.drop_recurring_lines(none),
        quality.score(none, quality.fit(none, labels)),
        pii.find_personal_data(none),
        simhash.near_duplicates(none),
        simhash.keep_unlike(none),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)
    captures = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "list string, key string, action string, at timestamp")
    assert url_lists.filter_captures(captures, entries).count() == 0


def test_long_texts_are_compared_whole(spark, docs):
    got = {r["doc_id"]: r for r in exact.exact_duplicates(docs).collect()}
    assert (got[1]["keep_id"], got[1]["kept"], got[2]["group_size"]) == (2, False, 2)
    assert got[1]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    other = docs.union(spark.createDataFrame([(6, LONG[:-1] + "!", "a")], docs.schema))
    assert {r["doc_id"]: r["group_size"] for r in exact.exact_duplicates(other).collect()}[6] == 1


def test_long_texts_are_scanned_whole(spark, docs):
    end = "the very last ten words of it stand right here"
    long = spark.createDataFrame([(1, LONG + end)], "doc_id long, text string")
    items = spark.createDataFrame([("i", end)], "item_id string, text string")
    row = decontaminate.decontaminate(long, items).first()
    assert (row["n_hit"], row["n_items"], row["n_words"]) == (10, 1, 7 * 40_000 + 10)


def test_long_texts_in_shards_and_mixes(spark, docs):
    got = {r["doc_id"]: r for r in sharding.shard(docs).collect()}
    assert (got[1]["size"], got[1]["text_crc32"], got[4]["size"]) == (len(LONG) + 16, zlib.crc32(LONG.encode()), 16)
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert sizes[1][0] == 7 * 40_000 and sizes[4] == (0, 0) and all(taken <= 2 * size for size, taken in sizes.values())


def test_long_lines(spark):
    line = "Words of one line again and again " * 40_000
    docs = spark.createDataFrame([(k, f"{line}\n{'abcdefghij'[k]} stays") for k in range(8)], "doc_id long, text string")
    got = templates.drop_recurring_lines(docs).collect()
    assert {(r["n_lines"], r["n_dropped"]) for r in got} == {(2, 1)} and all(r["kept_text"].endswith(" stays") for r in got)


def test_long_texts_are_scored_and_fingerprinted_whole(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert scored[1] == scored[2] and 0 <= scored[1] <= 1
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs.where("doc_id < 4")).collect()}  # 280,000 shingles
    assert found[1]["fp"] == found[2]["fp"] and found[2]["component_id"] == 1


def test_long_urls(spark):
    url = "http://a.example.com/" + "p" * 1_000_000
    captures = spark.createDataFrame([(1, url), (2, "http://" + "a." * 300 + "example.com/x")], "page_id long, url string").selectExpr("*", "timestamp'2024-05-01' as fetched_at")
    entries = spark.createDataFrame([("spam", "example.com", "add")], "list string, key string, action string").selectExpr("*", "timestamp'2024-01-01' as at")
    got = {r["page_id"]: r["blocked"] for r in url_lists.filter_captures(captures, entries).collect()}
    assert got == {1: True, 2: True}
