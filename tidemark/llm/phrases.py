"""Collocations: frequent phrases of 2 to ``MAX_WORDS`` words, scored, the longest of equals kept.

Two passes over the texts. The first hashes every phrase of 1 to ``MAX_WORDS`` words into a
count-min sketch; each chunk of about ``CHUNK_BYTES`` of text sends the cells it has touched,
in blocks of ``BLOCK`` cells, and a tree of groups of about ``FAN`` of them adds up each block
(sums stop at the threshold: only that is asked). A sketch never counts too little,
so a phrase with a cell under the threshold isn't frequent. The second pass drops
those (and phrases that hold a dropped one), counts the others exactly, by their words
and not by hashes, in pieces of ``PIECE_BYTES`` of text, and Spark sums these counts, combined
before the shuffle. What is shuffled there are the distinct survivors of a partition. Frequent phrases then meet the counts of their
parts by joins in which hot parts and languages are broadcast.

The sketch has ``ROWS`` rows of a power of two of cells, so many that a cell holds half
the threshold on the mean, from ``LEAST_CELLS`` up to ``MOST_CELLS``: what each task reads of it, a bit a cell,
is at most 64 MB. Beyond about 10 GB of text at a threshold of 100 it fills up, filters less and
the second pass sends more; results stay whole. Thresholds that grow with the corpus
keep it sharp.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows
count each time; words are bytes between spaces and tabs, so any character may be in one;
an empty table gives an empty result; other columns are ignored. A long text is a chunk
of its own and takes about 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_size, ship, written

MAX_WORDS = 5
MIN_COUNT = 100
PERCENT = 100
TOP = 2000
CHUNK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
ROWS = 2
LEAST_CELLS, MOST_CELLS = 1 << 24, 1 << 28
BLOCK = 1 << 18
FAN = 64
UNKNOWN = "und"
# A-Z to lower case, every splitter to "." and so to a word of its own.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _sketch_rows(cells: int) -> int:
    return cells.bit_length() - 1


class Words:
    """The words of some texts of one language: ``ids`` with -1 for a splitter, and ``names``."""

    def __init__(self, lang: str, texts: list[bytes]):
        import xxhash

        self.lang = lang
        joined = b".".join(texts).translate(_PLAIN).replace(b".", b" . ").strip(b" \t") or b"."
        coded = pc.ascii_split_whitespace(pa.array([joined], pa.large_binary()).view(pa.large_string())).values.dictionary_encode()
        names = coded.dictionary.view(pa.large_binary()).to_pylist()
        ids = coded.indices.to_numpy().astype(np.int64)
        stop = names.index(b".") if b"." in names else -1
        self.ids = np.where(ids == stop, -1, ids)
        self.names = names
        self.total = int((self.ids >= 0).sum())
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in names] or [0], np.uint64)


def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those without the last word and that word's."""
    x = (hashes ^ (hashes >> np.uint64(29))) * _STEP + last
    return (x ^ (x >> np.uint64(32))) * _ODD[0]


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    x = hashes * _ODD[row]
    return ((x ^ (x >> np.uint64(31))) * _STEP) >> np.uint64(64 - _sketch_rows(cells))


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending cells of a block and their counts, as gaps and counts by bytes of equal weight."""
    import zstandard

    both = np.concatenate([np.diff(at, prepend=0), counts]).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    gaps, counts = np.ascontiguousarray(planes.T).view(np.uint32).reshape(2, -1).astype(np.int64)
    return np.cumsum(gaps), counts


def sketched(words: list[Words], max_words: int, cells: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, block, cells) of all phrases of a chunk."""
    found = []
    for w in words:
        valid = w.ids >= 0
        own = w.hashes[w.ids]
        hashes = own
        for k in range(max_words):
            if k:
                hashes, valid = longer(hashes[:-1], own[k:]), valid[:-1] & (w.ids[k:] >= 0)
            found.append(hashes[valid])
    every = np.concatenate(found) if found else np.zeros(0, np.uint64)
    for row in range(ROWS):
        at = np.sort(cells_of(every, row, cells).astype(np.uint32))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        counts = np.minimum(np.diff(np.append(first, len(at))), most)
        at = at[first].astype(np.int64)
        block = min(BLOCK, cells)
        cuts = np.searchsorted(at, np.arange(0, cells + 1, block))
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if y > x:
                yield row, b, packed(at[x:y] - b * block, counts[x:y])


def survivors(w: Words, max_words: int, cells: int, bits: list[np.ndarray]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(phrases, counts) of 1 to ``max_words`` words whose cells are all heavy."""

    def heavy(hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(ROWS):
            at = cells_of(hashes, row, cells)
            out &= (bits[row][(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        return out

    known = np.concatenate([heavy(w.hashes), [False]])  # the last is the splitter, -1
    counts = np.bincount(w.ids[w.ids >= 0], minlength=len(w.hashes))
    alive = known[w.ids]
    here = np.flatnonzero(known[:-1] & (counts > 0))
    yield [w.names[i] for i in here.tolist()], counts[here]
    # Phrases of k words: where they start, their hashes, and which they are.
    start = np.flatnonzero(alive)
    hashes, which, names = w.hashes[w.ids[start]], w.ids[start], w.names
    for k in range(1, max_words):
        nxt = start + k
        fits = nxt < len(w.ids)
        fits[fits] = alive[nxt[fits]]
        # Both phrases of one word less are heavy: the one from the next word on is at start + 1.
        fits &= np.append(start[1:] == start[:-1] + 1, False)
        start, hashes, which = start[fits], hashes[fits], which[fits]
        last = w.ids[start + k]
        hashes = longer(hashes, w.hashes[last])
        fits = heavy(hashes)
        start, hashes, which, last = start[fits], hashes[fits], which[fits], last[fits]
        if not len(start):
            return
        key, which, counts = np.unique(which * len(w.names) + last, return_inverse=True, return_counts=True)
        names = [names[p] + b" " + w.names[q] for p, q in zip((key // len(w.names)).tolist(), (key % len(w.names)).tolist(), strict=True)]
        yield names, counts


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[Words]]:
    """The words of a partition, about ``most`` bytes at a time, by language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= most:
                yield [Words(k, v) for k, v in held.items()]
                held, size = {}, 0
    if held:
        yield [Words(k, v) for k, v in held.items()]


def heavy_cells(rows: DataFrame, cells: int, max_words: int, min_count: int) -> list[np.ndarray]:
    """For each row of the sketch a bit a cell, set where the merged count reaches ``min_count``."""
    spark = rows.sparkSession
    ship(spark)
    block = min(BLOCK, cells)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for words in _chunked(batches, CHUNK_BYTES):
            found = list(sketched(words, max_words, cells, min_count))
            if found:
                r, b, data = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int64()), pa.array([chunk] * len(r), pa.int64()), pa.array(data, pa.binary())], names=["row", "block", "chunk", "cells"])
            chunk += 1

    def merged(table: pa.Table) -> np.ndarray:
        sums = np.zeros(block, np.int64)
        for data in table.column("cells"):
            at, counts = unpacked(data.as_py())
            sums[at] = np.minimum(sums[at] + counts, min_count)
        return sums

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        sums = merged(table)
        at = np.flatnonzero(sums)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "chunk": pa.array([key[2].as_py()], pa.int64()), "cells": pa.array([packed(at, sums[at])], pa.binary())})

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "bits": pa.array([np.packbits(merged(table) >= min_count).tobytes()], pa.binary())})

    parts = written(rows.mapInArrow(build, "row int, block long, chunk long, cells binary"), "sketches", "uncompressed")
    n = parts.select("chunk").distinct().count()
    while n > FAN:
        n = -(-n // FAN)
        group = F.pmod(F.xxhash64("chunk"), F.lit(n))
        parts = written(parts.withColumn("chunk", group).groupBy("row", "block", "chunk").applyInArrow(add_up, parts.schema), "sketches", "uncompressed")
    bits = [np.zeros(max(cells, 8) // 8, np.uint8) for _ in range(ROWS)]
    done = parts.groupBy("row", "block").applyInArrow(finish, "row int, block long, bits binary")
    for r in done.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        bits[r["row"]][r["block"] * block // 8 :][: len(part)] = part
    return bits


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, cells: int | None = None) -> DataFrame:
    """(lang, phrase, n) of the phrases of up to ``max_words`` words that occur ``min_count`` times or
    more in their language, and of the empty phrase, whose n are all words of the language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    if cells is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        wanted = size * max_words // 6 * 2 // min_count  # about six bytes a word
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, wanted - 1).bit_length()))
    bits = spark.sparkContext.broadcast(heavy_cells(rows, cells, max_words, min_count))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _chunked(batches, PIECE_BYTES):
            for w in words:
                for names, counts in [([b""], np.array([w.total])), *survivors(w, max_words, cells, bits.value)]:
                    yield pa.RecordBatch.from_arrays([pa.array([w.lang] * len(names), pa.string()), pa.array(names, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

    counted = rows.mapInArrow(count, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= min_count) | (F.octet_length("phrase") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "n")


def _parts(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more of ``known``, a
    written result of ``frequent``: the lowest score over the cuts, the first of equal ones."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = known.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).select("*", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", _parts(F.col("words"), F.lit(1), F.col("k")).alias("first"), _parts(F.col("words"), F.col("k") + 1, F.size("words")).alias("rest"), F.lit("").alias("all"))
    cuts = written(cuts, "cuts")
    total = cuts.count()
    asked = cuts.select("lang", F.explode(F.array("first", "rest", "all")).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("asked"))
    parts = written(known.join(asked, ["lang", "phrase"]), "parts")
    for side, count in (("first", "l"), ("rest", "r"), ("all", "n")):
        table = parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count), F.col("asked").alias(f"{side}_asked"))
        cuts = join_by_size(cuts, table, ["lang", side], f"{side}_asked", total).drop(side, f"{side}_asked")
        cuts = written(cuts, "cuts") if side != "all" else cuts
    # Exact: products may need more than 64 bits, the quotient never does.
    wide = {c: f"cast({c} as decimal(19,0))" for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("score", F.expr(f"(({wide['a']} * {wide['n']}) * 1000) div ({wide['l']} * {wide['r']})"))
    order = F.col("score") * 8 + F.col("k")  # at most 80 n
    least = [F.min_by(c, order).alias(c) for c in ("l", "r", "score")]
    return cuts.groupBy("lang", "phrase", "a", "n").agg(*least).select("lang", "phrase", "a", "l", "r", "n", "score")


def outlasting(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``found`` that no longer phrase holds with ``percent`` of their count or more."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: _parts(F.col("words"), i, k))))
    held = found.select("lang", F.col("a").alias("longer"), words.alias("words")).where(F.size("words") > 2).select("lang", "longer", F.explode(inner).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, percent: int = PERCENT, top: int = TOP, cells: int | None = None) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    known = written(frequent(docs, text_col, lang_col, min_count, max_words, cells), "frequent")
    kept = outlasting(written(scored(known), "scored"), percent)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first of each of 64 parts of a language, then of these.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    some = kept.withColumn("__part", part).where(F.col("__part") <= top).drop("__part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
