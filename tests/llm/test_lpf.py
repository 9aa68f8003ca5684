import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import lpf


def brute(rows):
    """Set of LENGTH-byte strings with their smallest document, then marks."""
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        key = float("inf") if i is None else i
        for s in range(len(b) - lpf.LENGTH + 1):
            w = b[s : s + lpf.LENGTH]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        key = float("inf") if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - lpf.LENGTH + 1):
            if first[b[s : s + lpf.LENGTH]] < key:
                gone[s : s + lpf.LENGTH] = b"\1" * lpf.LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "an", " "]) for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(10, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(60, None), (61, ""), (62, "a" * 300), (63, "a" * 49), (64, "a" * 50), (65, "\0" * 120), (66, "x" + "\0" * 60), (67, rows[3][1]), (67, rows[5][1]), (None, rows[7][1]), (None, "b" * 99), (68, "b" * 99), (69, "ab" * 90), (2, passages[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 3)])
def test_matches_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = lpf.remove_repeats(df, block_bytes=4000, hot=hot)
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()), key=str)
    assert found == brute(rows)


def test_more_blocks_than_buckets(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lpf.remove_repeats(df, block_bytes=200, most_buckets=3, with_text=False)  # some hundred blocks
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_long_text_in_pieces(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long[600_000:600_400]), (2, long), (3, long[520_000:530_000] + "zz")]
    got = {r["doc_id"]: r for r in lpf.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (400, 1)
    assert bytes(got[3]["kept"]) == b"zz"


def test_empty_table(spark):
    assert lpf.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_previous_factors():
    """Against all pairs: the longest prefix shared with a suffix of a smaller document."""
    rng = random.Random(6)
    for n in (0, 1, 2, 40, 300):
        heads = np.array([[rng.choice(b"ab") for _ in range(7)] for _ in range(n)], np.uint8).reshape(n, 7)
        doc = np.array([rng.randrange(9) for _ in range(n)], np.int64)
        shared = lambda a, b: next((k for k in range(7) if a[k] != b[k]), 7)
        want = [max((shared(heads[i], heads[j]) for j in range(n) if doc[j] < doc[i]), default=0) for i in range(n)]
        assert lpf.previous_factors(heads, doc).tolist() == want


def test_previous_smaller():
    rng = random.Random(7)
    for values in ([], [3], [1, 1, 1], list(range(50)), list(range(50, 0, -1)), [rng.randrange(8) for _ in range(400)]):
        want = [max((j for j in range(i) if values[j] < v), default=-1) for i, v in enumerate(values)]
        assert lpf.previous_smaller(np.array(values, np.int64)).tolist() == want


def test_messages_grow_with_the_texts(spark):
    """Rows of round 1 for each byte are the same at two sizes, whatever the number of blocks."""
    rng = random.Random(8)
    sent = {}
    for n in (40, 160):
        rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(2000)), i % (n // 4)) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, text string, block long").selectExpr("id", "cast(text as binary) as text", "block")
        sent[n] = df.groupBy("block").applyInArrow(lpf._anchors, lpf._ANCHORS).count() / n
    assert abs(sent[40] - sent[160]) < 0.02 * sent[40]


def test_no_table_is_left(spark):
    df = spark.createDataFrame([(1, "a" * 80), (2, "a" * 80)], "doc_id long, text string")
    got = lpf.remove_repeats(df)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_blocks")]
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 80]
