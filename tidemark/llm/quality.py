"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms describe how a text is written, in any language: hashed trigrams of
character classes, and counted events of its words (a word repeating the one
before, all capitals, closed by symbols, the share of distinct words). Term
weights are log(1 + count) times an inverse document frequency; a truncated SVD
of the labelled rows gives the latent space.

The labelled side is bounded: at most ``PER_CLASS`` rows of each label, taken in
hash order, are fitted and broadcast (2 * 2,048 vectors of 48 floats, 0.8 MB,
whatever the corpus). Every document is scored: its cosine with *all* labelled
vectors is computed in blocks, and the ``NEIGHBOURS`` nearest vote with weight
similarity ** POWER, a vote counting as many labelled rows as it stands for. No
shuffle of documents, one pass over whole texts.

Defined results: null, empty and wordless texts get the share of label 1; with no
usable labels every score is 0.5; rows with another label than 0 or 1 are not
learned; of texts with one id the smallest is learned; an id with both labels
is learned with both; repeated rows are scored alike; an empty table gives an empty result; very
long texts are counted whole, in pieces; input columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import with_arrow_columns

PER_CLASS = 2048
LATENT = 48
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.7
ROWS = 256

_CLASS = np.full(256, 11, np.uint8)
for _chars, _k in ((b" \t\r", 0), (b"\n", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (bytes(range(128, 256)), 5), (b".?", 6), (b",;:", 7), (b"!", 8), (b"|/\\<>{}[]", 9), (b"#$%&*@^~_=+", 10)):
    _CLASS[list(_chars)] = _k
_K = 12
_EVENTS = 40
TERMS = _K**3 + _EVENTS
_SYMBOLS = frozenset(b"!#$%&*|")


def _events(text: bytes) -> np.ndarray:
    """Counts of word events, then one-hot ranges of shares, as heavy as the text is long."""
    out = np.zeros(_EVENTS)
    words = text.split()
    n = len(words)
    if not n:
        return out
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capitals = sum(w.isupper() for w in words)
    symbols = sum(w[-1] in _SYMBOLS for w in words)
    distinct = len(set(words)) / n
    length = sum(map(len, words)) / n
    out[0], out[1], out[2] = again, capitals, symbols
    out[4 + min(9, int(again / n * 10))] = n
    out[14 + min(9, int(distinct * 10))] = n
    out[24 + min(7, int(length / 2))] = n
    out[32 + min(7, int(symbols / n * 8))] = n
    return out


def term_counts(texts: list[bytes | None]) -> np.ndarray:
    """A row of TERMS counts for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            for at in range(0, len(text), 1 << 22):  # long texts in overlapping pieces
                k = _CLASS[np.frombuffer(text[at : at + (1 << 22) + 2], np.uint8)].astype(np.intp)
                row[: _K**3] += np.bincount((k[:-2] * _K + k[1:-1]) * _K + k[2:], minlength=_K**3)[: _K**3]
            row[_K**3 :] = _events(text)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class Model:
    """Latent space, labelled vectors, labels and what each vote counts."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, shares: dict[int, float], latent: int = LATENT):
        self.prior = shares.get(1, 0.0) if shares else 0.5
        self.labels = labels.astype(np.float32)
        self.empty = not len(labels)
        if self.empty:
            return
        df = (counts > 0).sum(axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + 1
        weighted = _unit(np.log1p(counts) * self.idf)
        rng = np.random.default_rng(0)
        q = np.linalg.qr(weighted.T @ (weighted @ rng.standard_normal((TERMS, latent + 16)).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(weighted.T @ (weighted @ q))[0]
        _, vectors = np.linalg.eigh((weighted @ q).T @ (weighted @ q))
        self.basis = (q @ vectors[:, ::-1][:, :latent]).astype(np.float32)
        self.vectors = _unit(weighted @ self.basis).astype(np.float32)
        seen = {k: float((labels == k).mean()) for k in (0, 1)}
        self.stands_for = np.array([shares.get(int(y), 0) / max(seen[int(y)], 1e-9) for y in labels], np.float32)

    def score(self, texts: list[bytes | None], neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.empty:
            return out
        k = min(neighbours, len(self.labels))
        for at in range(0, len(texts), ROWS):
            counts = term_counts(texts[at : at + ROWS])
            some = counts[:, _K**3 :].any(axis=1)
            cosines = _unit(_unit(np.log1p(counts[some]) * self.idf) @ self.basis) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** power * self.stands_for[near]
            total = votes.sum(axis=1)
            part = np.where(total > 0, (votes * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
            out[at : at + ROWS][some] = np.clip(part, 0, 1)
        return out


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class, never held-out ones."""
    usable = labels.select(id_col, F.col(label_col).cast("int").alias("y")).where(~held_out(F.col(id_col)) & F.col("y").isin(0, 1) & F.col(id_col).isNotNull()).distinct()
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = usable.where("y = 0").orderBy(*order).limit(per_class).union(usable.where("y = 1").orderBy(*order).limit(per_class))
    # Bounded by 2 * per_class rows, so it may be broadcast and, as counts, brought to the driver.
    found = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).where(F.length(F.trim(text_col)) > 0)
    found = found.groupBy(id_col, "y").agg(F.min(text_col).alias(text_col))

    def run(texts: list[bytes | None]) -> dict[str, list]:
        return {"counts": [row.tobytes() for row in term_counts(texts)]}

    rows = with_arrow_columns(found, text_col, T.StructType([T.StructField("counts", T.BinaryType())]), run, [id_col, "y"]).collect()
    rows.sort(key=lambda r: (r[0], r["y"], bytes(r["counts"])))
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    n = sum(totals.values())
    return Model(counts, np.array([r["y"] for r in rows], int), {k: v / n for k, v in totals.items()} if n else {})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes | None]) -> dict[str, list]:
        got = shared.value.score(texts)
        return {"score": got, "predicted": (got >= threshold).astype(np.int32)}

    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return with_arrow_columns(docs, text_col, added, run, keep)
