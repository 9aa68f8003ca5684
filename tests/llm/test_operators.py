"""Operators against brute-force versions on small fixtures with nulls, empty texts, ties and repeats."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, exact, mixing, pii, quality, sharding, simhash, templates, url_lists

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


# -- 3


def brute_decontaminate(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for i, text in docs:
        words = word.findall(lower(text))
        hit, found = set(), set()
        for k, item in items:
            iw = word.findall(lower(item))
            n = min(window, len(iw))
            wins = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if n else set()
            for a in range(len(words) - n + 1) if n else ():
                if tuple(words[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    found.add(k if k is None else str(k))
        digest = hashlib.sha256(",".join(sorted(k for k in found if k is not None)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


LONG_ITEM = " ".join(f"long{k % 97} item{k}" for k in range(3000))
DECON = [(None, "gamma delta"), (8, LONG_ITEM), (1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "é été, three-four"), (3, None), (4, ""), (5, "!!"), (6, "alpha beta " * 20), (10, "Three four")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 40_000])
def test_decontaminate(spark, part_bytes):
    rng = random.Random(3)
    bag = "one two three four five six seven eight nine ten eleven twelve alpha beta é été".split()
    docs = [(i, " ".join(rng.choice(bag) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    docs += [(30, "x. " + DECON[0][1].upper() + "?!"), (31, None), (32, ""), (33, "\0 . "), (30, "alpha-beta" * 9), (None, "THREE\nfour"), (34, "Gamma, delta!"), (35, LONG_ITEM[20_000:60_000]), (34, "Gamma, delta!")]
    df = spark.createDataFrame([(i, t, 7, "r", "i") for i, t in docs], "doc_id long, text string, n_hit long, runs string, items string")
    items = spark.createDataFrame(DECON, "item_id long, text string")
    got = decontaminate.decontaminate(df, items, part_bytes=part_bytes)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_decontaminate(docs, DECON, 10)
    assert got.columns[:4] == ["doc_id", "text", "runs", "items"] and {r["runs"] for r in got.collect()} == {"r"}
    spans = got.where("doc_id is null").first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 10)]


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = documents(spark, [(1, "a b", None)])
    assert not decontaminate.decontaminate(df, none).first()["contaminated"]
    assert decontaminate.decontaminate(df.limit(0), none).count() == 0


# -- 4

COPIES = [(1, "a", "s"), (2, None, "s"), (3, "", None), (4, "a", "t"), (4, "a", "t"), (5, "A", "s"), (6, "é" * 5000, "s"), (7, "é" * 5000, "s"), (None, "n", "s")]


@pytest.mark.parametrize(("bucket", "hot"), [(1, 512), (1, 1), (1 << 16, 512)])
def test_exact_duplicates(spark, bucket, hot, monkeypatch):
    monkeypatch.setattr(common.join_by_size, "__defaults__", (hot,))
    got = exact.exact_duplicates(documents(spark, COPIES), bucket_entries=bucket)
    groups = defaultdict(list)
    for i, t, _ in COPIES:
        groups[t or ""].append(i)
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    want = []
    for i, t, _ in COPIES:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=str)
    # Exactly one row of a group stays, and it has the largest id; groups without ids keep a row too.
    stays = got.where("kept").collect()
    assert len(stays) == len(groups) == len({r["text_sha256"] for r in stays})
    assert all(r["doc_id"] == r["keep_id"] for r in stays)
    for r in got.collect():
        assert r["bucket"] == f"{r['depth']}:{xxhash.xxh64_intdigest(texts[r['text_sha256']].encode(), 42) >> (64 - r['depth']) if r['depth'] else 0}"
    assert exact.exact_duplicates(documents(spark, [])).count() == 0
    if bucket == 1:
        assert got.agg({"depth": "max"}).first()[0] > 0


def test_directory_splits_only_overfull_buckets(spark):
    """Keys crowd one half: its buckets are deep, the other half is one bucket; copies split nothing."""
    rows = [(1 << 62) + (k << 40) for k in range(64)] + [-1] * 500
    cells, depth = exact.directory(spark.createDataFrame([(k,) for k in rows], "key long"), bucket_entries=20)
    got = cells.collect()
    assert max(r["depth"] for r in got) == depth > 1
    assert {r["depth"] for r in got if r["cell"] >> (depth - 1)} == {1}
    assert len({r["bucket"] for r in got}) >= 4


# -- 5


def brute_shard(doc_id, shards):
    weights = sharding.tree([1.0] * shards)

    def draw(level, child, weight):
        h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        h = xxhash.xxh64_intdigest(child.to_bytes(4, "little"), h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    node = weights
    for level in ("region", "rack", "shard"):
        at = min(node, key=lambda c: (draw(level, c, sharding._weight(node[c])), c))
        node = node[at]
    return at


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "é", None, "", "abc" * 50]), "s") for i in range(400)] + [(5, "x", "s")] * 3
    got = sharding.shard(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["shard"] == brute_shard(r["doc_id"], 40)
        assert r["grown_shard"] == brute_shard(r["doc_id"], 41)
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(documents(spark, [])).count() == 0
    assert sharding.shard(documents(spark, [(None, None, None)])).count() == 1


def test_weight_change_stays_in_its_subtree(spark):
    df = spark.range(4000)
    heavy = [1.0] * 40
    heavy[21] = 3.0
    moved = sharding.place(sharding.place(df, "id", "before", 40), "id", "after", weights=heavy).where("before <> after").collect()
    assert moved and all(r["after"] // 20 == 1 for r in moved)
    none = [1.0] * 39 + [0.0]
    assert sharding.place(df, "id", "after", weights=none).where("after = 39").count() == 0


def test_slots_of_repeated_rows(spark):
    """One row repeated far beyond a cell is numbered in pieces, without gaps."""
    df = spark.createDataFrame([(1, k % 2) for k in range(900)] + [(k, 0) for k in range(2, 300)], "id long, shard int").repartition(5)
    got = sharding.with_slots(df, "shard", [df["id"]], cell_rows=16).collect()
    for k in range(2):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_many_small_cells(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as shard")
    got = sharding.with_slots(df, "shard", [df["id"]], cell_rows=10).collect()
    for k in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


# -- 6


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, cut = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in cut)
        free = [s for s in names if s not in cut]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            return target | {s: 2.0 * sizes[s] for s in cut}
        cut |= above


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "d", "é", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, "w", "z"), (5, "w w", "a"), (None, "w\tw", "b"), (None, "w w w", "b")]
    got = mixing.mix(documents(spark, rows)).collect()
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(key(r) for r in got if r["doc_id"] is not None) == sorted(key(r) for r in again if r["doc_id"] is not None)


def test_mix_of_repeated_rows(spark):
    """Rows with one id and text are rounded by their number: targets are met and reruns agree."""
    rows = [(7, "w w w", "a")] * 700 + [(i, "w " * (i % 9), "a") for i in range(300)] + [(8, "w", "b")] * 3
    seen = []
    for parts in (3, 7):
        got = mixing.mix(documents(spark, rows).repartition(parts)).collect()
        assert len(got) == len(rows)
        for source in "ab":
            mine = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4
        seen.append(sorted((r["doc_id"], r["taken"]) for r in got))
    assert seen[0] == seen[1]


def test_mix_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_pivots_keep_expected_copies(spark):
    """Over many draws each document is taken about as often as its probability says."""
    rows = [(k, k % 7 + 1, k * 1000 + j, k * 1000 + j, 0.3) for k in range(200) for j in range(10)]
    df = spark.createDataFrame(rows, "source long, size long, seed long, uid long, p double")
    got = mixing.pivotal_rounding(df, 10, fan_in=3).collect()
    assert len(got) == len(rows) and {r["taken"] for r in got} <= {0, 1}
    assert sum(r["taken"] for r in got) / len(rows) == pytest.approx(0.3, abs=0.05)


# -- 8


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = " ".join(word() + ("" if good else rng.choice(["***", "$$$", "###"])) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, "s"))
        labels.append((i, int(good), 0))
    docs = documents(spark, [*rows, (1000, None, "s"), (1001, "", "s"), (1002, " \n ", "s"), (1, "dup", "s")])
    lab = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, lab)
    got = quality.score(docs, model).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95
    other = lab.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    changed = quality.score(docs, quality.fit(docs, other)).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in changed) == sorted((str(r["doc_id"]), r["score"]) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {model.prior}


def test_quality_without_labels(spark):
    docs = documents(spark, [(1, "a b", None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5]
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


# -- 9

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for order, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and brute_luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def pii_rows():
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "@z.w", "u_v@h-i.j.k@l.mn", "a@b.c_d@e.fg", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0255", "4111 1111 1111 1111", "4111111111111112", "0000-0000-0000", "+1 (555) 123-4567", "+44.20.7946.0958 ", "+1+22", "é", "日本", "\n", "12", "9" * 25, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "🙂", "."]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "s") for i in range(300)]
    return rows + [(400, None, "s"), (401, "", None), (402, "a" * 4_000, "s"), (403, "1" * 4_000, "s"), (404, "1 " * 3_000, "s"), (405, "a.b@c.de " * 400, "s"), (1, "repeat", "s"), (406, "." * 4_000 + "@", "s")]


def test_personal_data(spark):
    rows = pii_rows()
    got = pii.find_personal_data(documents(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] for r in got}
    for r in got:
        spans = brute_spans(r["text"])
        for order, kind in enumerate(PLAIN):
            assert r[f"n_{kind}"] == sum(s[1] == order for s in spans), (kind, r["text"][:300])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{a}:{b}" for a, _, b, k in spans} <= set(every)
    secrets = [r for r in got if (r["text"] or "").startswith("token = ")]
    assert len(text) and all("other" in r["spans"] for r in secrets)


def test_candidates_without_digits(spark):
    """Each generator is tried on every text it can match: no digit is needed."""
    texts = ["password: correcthorsebatterystaple", "at de:ad:be:ef:ca:fe", "me [at] host [dot] com", "call 555 123 4567", "nothing"]
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    df = documents(spark, [(i, t, None) for i, t in enumerate(texts)]).select("doc_id", pii._candidates(text, none, pii.has_digit(text)).alias("c"))
    got = {r["doc_id"]: [(c["start"], c["end"]) for c in r["c"]] for r in df.collect()}
    assert got == {0: [(10, 35)], 1: [(3, 20)], 2: [(0, 22)], 3: [(5, 17)], 4: []}


ADDED = {
    "password: correcthorsebatterystaple": "other:10:35",
    "at de:ad:be:ef:ca:fe now": "other:3:20",
    "at 20aa:db8::ff00:42:8329 now": "other:3:25",
    "me [at] host [dot] com": "other:0:22",
    "call 555 123 4567": "other:5:17",
    "seen 12:30:45:00:11": "",
    "longwordswithoutanymeaning": "",
    "room 12-34-5": "",
}


@pytest.mark.parametrize("copies", [1, 40])
def test_each_generator_adds_its_spans(spark, copies):
    """By format checks where a class is too small to fit, and by fitted trees."""
    rng = random.Random(11)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda n: "".join(rng.choice("abcdefghijklm") for _ in range(n))
    rows = [(t, t, None) for t in ADDED]
    for _ in range(copies if copies > 1 else 0):
        rows += [(None, t, None) for t in (
            f"password: {word(25)}", f"at {':'.join(hexed(2) for _ in range(6))} now", f"at {hexed(4)}:{hexed(3)}::{hexed(4)}:{hexed(2)}:{hexed(4)} now",
            f"{word(2)} [at] {word(4)} [dot] com", f"call {rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
            f"seen {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}:00:11", word(26), f"room {rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1, 9)}",
        )]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "name string, text string")
    got = {r["name"]: r["spans"] for r in pii.find_personal_data(df).collect() if r["name"]}
    assert got == ADDED


def test_personal_data_empty(spark):
    assert pii.find_personal_data(documents(spark, [])).count() == 0


# -- 10


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def near_copies():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([3, 60, 250, 400]))]
        for k in range(12):
            mine = list(words)
            for _ in range(rng.randint(0, 3)):
                mine[rng.randrange(len(mine))] = word()
            rows.append((base * 12 + k, rng.choice([" ", "\n", "\t "]).join(mine).upper() if k % 5 == 0 else " ".join(mine), "s"))
    return rows + [(900, None, "s"), (901, "", "s"), (902, " \t\n", "s"), (903, "Ab é", "s"), (904, "aB é", "s")]


def test_simhash(spark):
    rows = near_copies()
    want = {i: brute_fingerprint(t) for i, t, _ in rows}
    comps = brute_components(want)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == want
    assert {r["doc_id"]: r["component_id"] for r in got} == comps
    assert len(set(comps.values())) < len(rows) - 50
    kept = simhash.keep_representatives(documents(spark, rows)).collect()
    assert {r["doc_id"] for r in kept} == set(comps.values())
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    loose = documents(spark, [(None, "a b c d e", None), (None, "a b c d e", None), (3, "q w e r t y", None), (None, "q w e r t y", None)])
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(loose).collect()) == [(0, 0), (0, 0), (0, 3), (3, 3)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_representatives(loose).collect()) == [(0, "a b c d e"), (3, "q w e r t y")]


@pytest.mark.parametrize("bucket_rows", [3, 1 << 18])
def test_links_of_random_fingerprints(spark, bucket_rows):
    """Dense balls of fingerprints, split buckets too: the components are exact."""
    rng = random.Random(9)
    prints = {}
    for _ in range(8):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.setdefault(len(prints), centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) % (1 << 64))
    prints = {i: p for p, i in {p: i for i, p in reversed(prints.items())}.items()}
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()]
    nodes = spark.createDataFrame(signed, "fp long, node long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, bucket_rows=bucket_rows)).collect()}
    assert {i: found.get(i, i) for i in prints} == brute_components(prints)


# -- 7


def brute_templates(rows, min_docs=3):
    def mask(line):
        return " ".join(templates.WILD if any("0" <= c <= "9" for c in w) else w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)

    held = defaultdict(list)  # masked line -> rows
    unit = [i if i is not None else f"row {k}" for k, (i, _) in enumerate(rows)]
    for k, (_, text) in enumerate(rows):
        for line in {mask(x) for x in (text or "").split("\n")} - {""}:
            held[line].append(k)
    leaves = defaultdict(list)
    for line in held:
        words = line.split(" ")
        leaves[len(words), tuple(words[: templates.DEPTH])].append(line)
    docs, of = defaultdict(set), defaultdict(set)
    for leaf, members in leaves.items():
        if len({unit[k] for m in members for k in held[m]}) < min_docs:
            continue
        every = sum(len(held[m]) for m in members)
        count = defaultdict(int)
        for m in members:
            for pos, w in enumerate(m.split(" ")):
                count[pos, w] += len(held[m])
        for m in members:
            words = m.split(" ")
            of[m].add((leaf, tuple(words)))
            for share in templates.SHARES:
                shape = tuple(w if count[p, w] >= max(min_docs, share * every) else None for p, w in enumerate(words))
                if sum(w is not None for w in shape) >= templates.SIMILAR * len(words):
                    of[m].add((leaf, shape))
            for t in of[m]:
                docs[t] |= {unit[k] for k in held[m]}
    gone = {m for m, ts in of.items() if any(len(docs[t]) >= min_docs for t in ts)}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if mask(x) not in gone]
        out.append((i, len(lines) if text else 0, len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [512, 2])
def test_line_templates(spark, hot, monkeypatch):
    monkeypatch.setattr(common.join_by_size, "__defaults__", (hot,))
    rng = random.Random(10)
    rows = []
    for i in range(40):
        lines = [f"Copyright {rng.randint(1990, 2024)} by {rng.choice(['Ann', 'Bob', 'Cy'])} all rights reserved", "".join(rng.choice("abc ") for _ in range(rng.randint(0, 20))), f"page {i} of {rng.choice(['many', 'few', 'some'])} shown", "same  line\there"]
        lines.append(f"this is a text by {rng.choice('abcdefghijklmn') * 3} for {rng.choice(['all', 'us'])} of my best friends here")
        lines.append(f"this is a {rng.choice(['book', 'song'])} by {rng.choice('abcdefghijklmn') * 3} on {rng.choice(['her', 'his'])} long way back home again")
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines[: rng.randint(0, 6)])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, "same line here"), (103, "x9" * 5000), (104, "w " * 3000)]
    rows += [(None, "no id line"), (None, "no id line\r"), (None, "no id  line\nsame line here"), (105, "twice here now"), (105, "twice here now"), (105, "twice here now")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id long")
    got = templates.drop_recurring_lines(df, min_docs=3)
    want = brute_templates(rows)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_text") == want
    assert templates.drop_recurring_lines(df.limit(0)).count() == 0
    assert any(t == "twice here now" for *_, t in want) and not any("no id" in t for *_, t in want)


def test_several_templates_in_a_leaf(spark):
    """Two frequent templates with varying names share a leaf: both are found, whatever their shares."""
    name = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    first = [f"written by the {name(k)} team of our newspaper for all readers" for k in range(40)]
    second = [f"written by the {name(k)} office in this country near two rivers" for k in range(100, 160)]
    rest = [f"written by the {name(k)} {name(k + 1)} {name(k + 2)} {name(k + 3)} {name(k + 4)} {name(k + 5)} {name(k + 6)} {name(k + 7)}" for k in range(200, 800, 9)]
    rows = list(enumerate(first + second + rest))
    got = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_dropped"]} == set(range(100))


# -- 1


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [
            ("ads", "b.com", "add", "2024-01-10 00:00:00"),
            ("ads", "b.com", "add", "2024-01-20 00:00:00"),
            ("ads", "b.com", "remove", "2024-03-01 00:00:00"),
            ("bad", "a.b.com", "add", "2024-02-01 00:00:00"),
            ("bad", "a.b.com", "remove", "2024-02-01 00:00:00"),
            ("bad", "a.b.com/x", "add", "2024-02-05 00:00:00"),
            (None, "b.com", "add", "2024-01-01 00:00:00"),
            ("ads", None, "add", "2024-01-01 00:00:00"),
            ("ads", "c.com", "keep", "2024-01-01 00:00:00"),
        ],
        "list string, key string, action string, at string",
    ).selectExpr("list", "key", "action", "cast(at as timestamp) as at")
    rows = [
        (1, "http://A.b.com/x/1", "2024-01-09 23:59:59", ""),
        (2, "http://A.b.com/x/1", "2024-01-10 00:00:00", "ads"),
        (3, "https://u:p@a.b.com:80/x?y", "2024-02-05 00:00:00", "ads,bad"),
        (4, "http://a.b.com/y", "2024-02-29 23:59:59", "ads"),
        (5, "http://a.b.com/x", "2024-03-01 00:00:00", "bad"),
        (6, None, "2024-02-05 00:00:00", ""),
        (7, "nonsense", "2024-02-05 00:00:00", ""),
        (8, "http://b.com", None, ""),
        (9, "http://c.com/", "2030-02-05 00:00:00", ""),
        (2, "http://A.b.com/x/1", "2024-01-10 00:00:00", "ads"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched string, want string").selectExpr("*", "cast(fetched as timestamp) as fetched_at", "'x' as lists")
    got = url_lists.filter_captures(df, entries).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lists"] == r["want"] and r["blocked"] == bool(r["want"]), r
    assert url_lists.filter_captures(df.limit(0), entries).count() == 0
    assert url_lists.filter_captures(df, entries.limit(0)).where("blocked").count() == 0
