"""The pipeline's stages against brute force on a small corpus."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_decontaminate, brute_fingerprint, brute_shard, brute_targets
from tidemark.llm import simhash

ITEM = "which long and winding question was asked here by someone unknown before today"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(240):
        good = i % 6 != 0
        text = " ".join(word() + ("" if good else "***") for _ in range(rng.randint(30, 80)))
        if i % 20 == 1:
            text += " " + ITEM
        if i % 10 == 3:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, path)
        got = df.collect()
        kept.append(got)
        docs = spark.createDataFrame(got, df.schema)
    good, single, clean, mixed, sharded = kept
    assert all(list(r.asDict()) == corpus_pipeline.COLUMNS for stage in kept[:-1] for r in stage)
    # Quality: the bad texts go, clean ones stay.
    ids = {r["doc_id"] for r in good}
    bad = {i for i, text, *_ in rows if text and "***" in text}
    assert not ids & bad and len(ids) >= 0.98 * (len(rows) - len(bad))
    # Near-duplicates: the smallest of each group stays.
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in good}
    assert {r["doc_id"] for r in single} == set(brute_components(prints).values())
    # Benchmark.
    marked = brute_decontaminate([(r["doc_id"], r["text"]) for r in single], [(1, ITEM)], 10)
    assert {r["doc_id"] for r in clean} == {m[0] for m in marked if not m[5]}
    assert len(clean) < len(single)
    # Mix: up to twice each, near the targets.
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in clean} and max(copies.values()) <= 2
    size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in clean:
        n = len((r["text"] or "").split())
        size[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
        most[r["source"]] = max(most[r["source"]], n)
    for source, target in brute_targets(dict(size)).items():
        assert abs(taken[source] - target) <= most[source] / 2 + 1e-6
    # Shards.
    assert Counter(r["doc_id"] for r in sharded) == copies
    slots = defaultdict(list)
    for r in sharded:
        assert r["shard"] == brute_shard(r["doc_id"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages(spark, tables):
    path, _ = tables
    one = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect())
    two = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect())
    assert one == two and one


def test_repeated_and_missing_ids(spark, tables):
    """Rows of one id, or without one, stay rows of their own in every stage."""
    path, _ = tables
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b", None, "s", 3), (1, "c d e", None, "s", 5), (None, "x y", None, "s", 3), (None, "z", None, "s", 1), (2, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, schema)
    copies = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixed(spark, docs, path).collect())
    assert set(copies) == {r[:2] for r in rows} and set(copies.values()) <= {1, 2}
    single = corpus_pipeline.without_near_duplicates(spark, docs, path).collect()
    assert sorted(r["text"] for r in single) == ["a b", "c d e", "x y", "z"]
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.without_benchmark, corpus_pipeline.sharded):
        assert stage(spark, docs, path).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def brute_like(rows, words=5):
    """Keeps one of each group linked by Jaccard likeness 0.8 of five-word shingles."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for g, row in zip(group, rows, strict=True):
        first[g] = min(first.get(g, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted(first.values(), key=str)


@pytest.mark.parametrize("block", [100, 1 << 22])
def test_near_duplicates_at_likeness(spark, tables, monkeypatch, block):
    """Copies 0.8 to 0.95 alike go, less alike ones stay, with repeated and missing ids."""
    path, _ = tables
    monkeypatch.setattr(simhash.like_links, "__defaults__", (0.8, block, 2 if block == 100 else 512))
    rng = random.Random(21)
    rows = []
    for base in range(25):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 90, 200]))]
        for k in range(7):
            mine = list(text)
            for _ in range(rng.randint(0, max(1, len(mine) // 25))):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(5000)}"
            rows.append((None if k == 3 else base * 7 + k % 5, " ".join(mine)))
    rows += [(900, None), (901, ""), (902, " "), (1, "another text of the id one")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).repartition(3)
    got = corpus_pipeline.without_near_duplicates(spark, docs, path).collect()
    want = brute_like(rows)
    # Which of two rows with one id stays may differ in text; ids and the number of rows may not.
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(i) for i, _ in want)
    assert len(want) < len(rows) - 20
    tight = simhash.keep_representatives(docs.where("doc_id is not null")).count()
    assert len(want) < tight


def test_sets_meet_by_fingerprint(spark):
    """Alike sets without a common band meet by fingerprints within the radius; unlike ones are not linked."""
    words = lambda *n: b"".join(i.to_bytes(4, "little") for i in n)
    rows = [(0, 10, 0, 10, [1], words(*range(10))), (1, 11, 1, 10, [2], words(*range(9), 99)), (2, 12, 3, 10, [3], words(*range(50, 60)))]
    df = spark.createDataFrame(rows, "__row long, __node long, __fp long, __size long, __bands array<long>, __set binary")
    assert [tuple(r) for r in simhash.like_links(df).collect()] == [(10, 11)]
