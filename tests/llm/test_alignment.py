"""Token alignment against a two-pointer merge in plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import alignment


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)


def plain_tokens(both, text):
    """[(id, bytes)] of each side, or nothing."""
    a, b = both
    if not text:
        return [], []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in found.ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = b" " + text.encode()
    return (left, right) if b"".join(t for _, t in left) == whole == b"".join(t for _, t in right) else ([], [])


def plain_merge(left, right):
    """(groups of ids, links of ids)."""
    groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
    open_a, open_b = [], []
    while i < len(left):
        a, b = left[i], right[j]
        links.append((a[0], b[0]))
        end_a, end_b = at_a + len(a[1]), at_b + len(b[1])
        if end_a <= end_b:
            open_a.append(a[0])
            i, at_a = i + 1, end_a
        if end_b <= end_a:
            open_b.append(b[0])
            j, at_b = j + 1, end_b
        if end_a == end_b:
            groups.append((open_a, open_b))
            open_a, open_b = [], []
    return groups, links


def plain(both, texts):
    merged = [(*plain_tokens(both, t), *plain_merge(*plain_tokens(both, t))) for t in texts]
    counts = Counter(link for *_, links in merged for link in links)
    best_b, best_a = Counter(), Counter()
    for (a, b), n in counts.items():
        best_b[b], best_a[a] = max(best_b[b], n), max(best_a[a], n)
    out = []
    for left, right, groups, links in merged:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((len(left), len(right), len(groups), len(links), sum(counts[x] == best_b[x[1]] for x in links), sum(counts[x] == best_a[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256"]
PARTS = ["the ", "ing", "Ünïcödé ", "日本語", "😀", "  ", "\n\n", "\t", "tokenization ", "don't ", "a", "<s>", "<|endoftext|>", "1234 ", "\x00", "é", " ", "...", "ﬁ", "\r\n", "supercalifragilistic"]


def made_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return [*texts, None, "", " ", "  ", "a ", " a", "a▁b", "the cat", "the cat", "x" * 5000, "the cat sat " * 3000, "no  two   spaces   alike "]


def test_equals_two_pointer_merge(spark, both):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want, counts = plain(both, texts)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = {(r["a_id"], r["b_id"]): r["n"] for r in alignment.pair_counts(docs).collect()}
    assert pairs == counts


def test_small_chunks_and_forgotten_words_give_the_same(spark, both, monkeypatch):
    texts = made_texts()[:60]
    want, _ = plain(both, texts)
    t = alignment.Tokenizers(open(alignment.A_FILE, "rb").read(), open(alignment.B_FILE, "rb").read())
    monkeypatch.setattr(alignment, "WORDS", 20)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 100)
    encoded = [x.encode() for x in texts]
    got = []
    for start, stop in alignment._chunks_of(list(map(len, encoded))):
        out, pairs, times = alignment.merge(t, encoded[start:stop])
        assert times.sum() == sum(out["n_links"])
        got += list(zip(*(list(map(int, out[c])) for c in COLUMNS[:4]), out["groups_sha256"], strict=True))
    assert got == [(*w[:4], w[7]) for w in want]


def test_tokens_and_ends(spark, both):
    texts = ["the cat  sat", None, "Ünïcödé 😀"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in alignment.align(docs, with_tokens=True).collect():
        left, right = plain_tokens(both, texts[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"]) == ([i for i, _ in left], [i for i, _ in right])
        for ends, side in ((r["a_ends"], left), (r["b_ends"], right)):
            assert ends == [sum(len(t) for _, t in side[: k + 1]) for k in range(len(side))]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(bytearray(b"ab \xff"), None, 7), (bytearray(b"ab"), 1, 8)], "text binary, doc_id long, n_a int")
    found = alignment.align(docs)
    assert found.columns[:2] == ["text", "doc_id"] and found.columns.count("n_a") == 1
    assert sorted((r["doc_id"] or 0, r["n_a"] > 0, r["groups_sha256"] == "") for r in found.collect()) == [(0, False, True), (1, True, False)]
    assert alignment.align(docs.limit(0), keep=[]).columns == ["n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256"]
    assert alignment.align(docs.limit(0)).count() == 0 and alignment.pair_counts(docs.limit(0)).count() == 0
    assert alignment.align(docs.where("doc_id is null")).first()["count_sum"] == 0
