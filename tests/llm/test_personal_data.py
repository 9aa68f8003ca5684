"""Added spans of personal data: recall and precision on planted spans, and the scoring recomputed in plain Python."""

import random
import re

import pytest

from tests.llm.test_operators import brute_luhn, brute_spans, documents
from tidemark.llm import pii


def planted(n, seed=21):
    """(text, [(kind, start, end)], decoys): what the base patterns cannot find, decoys and prose."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexed = lambda k: pick("0123456789abcdef", k)
    mixed = lambda k: pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k)
    word = lambda k=None: pick("etaoinshrdlu", k or rng.randint(2, 9))

    def card():
        while True:
            d = "4" + pick("0123456789", 15)
            if brute_luhn(d):
                return d

    kinds = {
        "named key": lambda: (f'{rng.choice(["token", "api_key", "secret"])} = "', rng.choice([hexed(32), hexed(40), mixed(rng.randint(24, 44)) + "7"]), '"'),
        "named password": lambda: ("password: ", word(rng.randint(17, 24)), ""),
        "unnamed key": lambda: ("see ", mixed(rng.randint(28, 40)) + rng.choice("23456789"), ""),
        "phone": lambda: ("call ", f"{rng.randint(200, 999)}{(c := rng.choice(' .-'))}{rng.randint(100, 999)}{c}{rng.randint(1000, 9999)}", " now"),
        "two cards": lambda: ("paid ", card() + card(), " twice"),
        "spelled address": lambda: ("", f"{word()} [at] {word(5)} [dot] {rng.choice(['com', 'org', 'net'])}", ""),
        "hardware address": lambda: ("at ", ":".join(hexed(2) for _ in range(6)), ""),
        "IPv6": lambda: ("from ", ":".join(hexed(4) for _ in range(8)), " on"),
    }
    decoys = [
        lambda: word(rng.randint(16, 30)), lambda: f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}:00:11",
        lambda: "/".join(word(6) for _ in range(4)), lambda: f"order {rng.randint(100000, 999999)}", lambda: f"room {rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1, 9)}", lambda: f"{word()} (at {word()}) dot",
        lambda: f"{rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(10, 99)}", lambda: "-".join(word(5) for _ in range(4)),
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(3, 20))) + " ", []
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                kind = rng.choice(list(kinds))
                before, value, after = kinds[kind]()
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
                text += before + value + after
            else:
                text += rng.choice(decoys)()
            text += " " + " ".join(word() for _ in range(rng.randint(1, 8))) + " "
        out.append((text, spans))
    return out, list(kinds)


@pytest.fixture(scope="module")
def found(spark):
    rows, kinds = planted(3000)
    docs = documents(spark, [(i, t, None) for i, (t, _) in enumerate(rows)]).cache()
    booster = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, booster=booster).collect()}
    return rows, kinds, booster, got


def test_recall_and_precision(found):
    rows, kinds, booster, got = found
    assert booster.trees
    hit, all_, wrong, n = dict.fromkeys(kinds, 0), dict.fromkeys(kinds, 0), 0, 0
    for i, (_, spans) in enumerate(rows):
        added = [(r["start"], r["end"]) for r in got[i]["redactions"] if r["kind"] == pii.EXTRA]
        for kind, a, b in spans:
            all_[kind] += 1
            hit[kind] += any(s <= a and b <= e for s, e in added)
        n += len(added)
        wrong += sum(not any(s < b and a < e for _, a, b in spans) for s, e in added)
    recall = {k: round(hit[k] / all_[k], 3) for k in kinds}
    print("recall", recall, "precision", round(1 - wrong / n, 4), "spans", n)
    assert all(v >= 0.9 for k, v in recall.items()), recall
    assert wrong / n <= 0.05


def _tree(node):
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def brute_features(text, start, value):
    digits = re.sub("[^0-9]", "", value)
    letters = re.sub("[^A-Za-z]", "", value)
    before = text[max(0, start - pii.CONTEXT) : start]
    quad = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value)
    return [float(x) for x in (
        len(value), len(digits), len(letters), len(re.sub("[^A-Z]", "", value)), len(value) - len(digits) - len(letters), bool(re.fullmatch("[0-9a-fA-F]+", value)), len(re.split("[^0-9A-Za-z]+", value)),
        12 <= len(digits) <= 19 and brute_luhn(digits), bool(quad) and all(int(p) <= 255 for p in value.split(".")), len(digits) / max(1, len(value)),
        bool(re.search(r"[:=][\x20\"']{0,3}$", before)), bool(re.search("[\"']$", before)), bool(re.search(r"\+[0-9]{0,3}\x20?$", before)), bool(re.search(r"[A-Za-z][.!?,]?\x20$", before)),
    )]


def test_scores_match_plain_python(found):
    """Candidates, features, trees and thresholds again, by another road."""
    rows, _, booster, got = found
    trees = [(_tree(node), w) for node, w in booster.trees]
    for i, (text, _) in enumerate(rows[:600]):
        base = [(a, b) for a, _, b, _ in brute_spans(text)]
        want = set()
        for generator, pattern in pii.GENERATORS.items():
            for m in re.finditer(pattern, text):
                value = m[0].rstrip(" ")
                a, b = m.start(), m.start() + len(value)
                if any((s <= a and e >= b) or (s >= a and e <= b and 2 * (e - s) >= b - a) for s, e in base):
                    continue
                x = brute_features(text, a, value)
                margin = booster.margins[generator]
                if margin is not None and sum(w * _value(t, x) for t, w in trees) >= margin:
                    want.add((a, b))
        assert {(r["start"], r["end"]) for r in got[i]["redactions"] if r["kind"] == pii.EXTRA} == want, text


def test_unknown_candidates_are_not_negative(spark):
    """A key without a name, and a number that touches a base span, are not fitted as negatives."""
    texts = ["see 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f00 there", "call 55-66-77-88-99-11-22-33/4111111111111111", "longwordswithoutanymeaning", "seen 1999-02-03 there"]
    got = pii.proposed(documents(spark, [(i, t, None) for i, t in enumerate(texts)]), [pii.F.col("doc_id")]).collect()
    labels = {r["doc_id"]: {c["generator"]: c["label"] for c in r["candidates"]} for r in got}
    assert labels == {0: {"token": None}, 1: {k: None for k in labels[1]}, 2: {"token": 0.0}, 3: {"digits": 0.0}}


def test_occurrences_in_blocks_are_those_of_one_fold(spark):
    import random
    import re

    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = ["", "x", "12", *("".join(rng.choice(["ab ", "é", "1", "22 ", "😀", "345", " ", "\n"]) for _ in range(n)) for n in (3, 130, 131, 700, 3000))]
    texts += ["7 " * k for k in (63, 64, 65, 128, 129)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", pii.occurrences(F.col("text"), "[0-9]+", pii.CONTEXT).alias("found")).collect():
        t = texts[r["i"]]
        want = [(m.start(), m.end(), m.group(), t[max(0, m.start() - pii.CONTEXT) : m.start()]) for m in re.finditer("[0-9]+", t)]
        assert [tuple(x) for x in r["found"]] == want


def test_a_million_characters_with_many_spans(spark):
    import time

    parts = [f"write to user{i}@example{i % 7}.com or password: Ab{i:06d}xYz12345 é" if i % 2 else f"call +1 202 555 {i % 10000:04d} now" for i in range(20_000)]
    text = " ".join(parts)
    df = spark.createDataFrame([(1, text), (2, "user1@example.com")], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in pii.find_personal_data(df, booster=pii.Booster([], {})).collect()}
    assert time.time() - began < 120  # a fold that copies its array at each step takes hours
    assert (found[1]["n_email"], found[1]["n_phone"], found[1]["n_other"]) == (10_000, 10_000, 10_000)
    at = 0
    emails = []
    for i, part in enumerate(parts):
        if i % 2:
            emails.append((at + 9, at + part.index(" or ")))
        at += len(part) + 1
    assert [(s["start"], s["end"]) for s in found[1]["redactions"] if s["kind"] == "email"] == emails
    assert found[2]["spans"] == "email:0:17"


def test_every_candidate_is_fitted(spark, tmp_path, monkeypatch):
    """No candidate is left out, however many there are: 60,000 documents, 24,000 values of one generator."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.sql import functions as F

    i = F.col("id")
    number = F.concat_ws(" ", F.lit("call"), (200 + i % 700).cast("string"), (100 + F.floor(i / 700) % 700).cast("string"), (1000 + i % 9000).cast("string"), F.lit("now"))
    spark.range(60_000).select(F.when(i < 24_000, number).when(i % 2 == 0, F.concat(F.lit("room 12-34-"), i)).otherwise("nothing").alias("text")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labelled = pii.proposed(docs, []).select(F.explode_outer("candidates").alias("c")).where("c.label is not null and pmod(c.value, 4) <> 0")
    want = labelled.select("c.generator", "c.value", "c.covered", "c.label", *(f"c.{f}" for f in pii.FEATURES)).distinct().count()
    sizes, fit = [], GBTClassifier.fit

    def counted(self, data, *more):
        sizes.append(data.agg(F.sum("n")).first()[0] if "n" in data.columns else data.count())
        return fit(self, data, *more)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    assert pii.train(docs).trees
    assert want > 20_000 and sizes == [3 * want]
