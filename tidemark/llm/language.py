"""Language of a text by rank-order profiles.

A profile ranks the most frequent n-grams of 1 to 3 characters: of a language, over the
texts learned from; of a document, over its whole text. Words are runs of letters and
combining marks, lower-cased and closed by one space on each side; no n-gram reaches over
a space. The out-of-place distance of a document to a language adds up, over the ``PROFILE``
most frequent n-grams of the document, how far the language's rank is from the document's,
and ``DEPTH`` for n-grams that the language does not rank. The nearest language wins.
Equal counts share the mean of their ranks, so that no order of n-grams decides; a document's
ranks are stretched by the share of the language's profile that its own one fills
(a short text has few n-grams, all with small counts).

Learning takes about ``PER_LANG`` texts of each language (all, where there are no more),
picked by a hash of the text, as a classifier's bounded sample; their n-grams are counted
by Spark, and ``DEPTH`` n-grams of each language reach the driver and are broadcast.
Languages are a closed set: more than ``MOST_LANGUAGES`` of them are refused, so that the
profiles take 320 MB at most (0.1 MB for four). Documents are scored where they lie, without
a shuffle; a text takes about 100 bytes of memory for each of its characters.

Defined results: null texts and texts without a letter get ``und`` and score 0; so does
every text where nothing was learned. Rows without an id, without a language and with a
held-out id are not learned. Equal distances go to the first language by name. Bytes that
are not UTF-8 count as separators. Repeated rows are scored alike; an empty table gives an
empty result; input columns named like an added one are replaced, others are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship, with_arrow_columns

PER_LANG = 4096
DEPTH = 2000
PROFILE = 400
MOST_LANGUAGES = 200
UNKNOWN = "und"
_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point: 2 a letter, 1 a combining mark, 0 a separator."""
    if not _tables:
        kinds = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int8, 0x110000) * 2
        marks = np.fromiter((unicodedata.combining(chr(c)) > 0 or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000)
        kinds[marks & (kinds == 0)] = 1
        _tables.append(kinds)
    return _tables[0]


def gram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, packed with 21 bits a character, in order, and their counts;
    none where it has no letter."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    kinds = _kinds()[codes]
    if not (kinds == 2).any():
        return none
    codes = np.where(kinds > 0, codes, 32)
    codes = np.concatenate([[32], codes, [32]])
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    inside = codes != 32
    two = (codes[:-1] << 21) | codes[1:]
    three = ((two[:-1] << 21) | codes[2:])[inside[1:-1]]
    grams = np.sort(np.concatenate([codes[inside], two, three]))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams (of equal ones the first) and their ranks from 0,
    the mean of their ranks for those of equal counts."""
    order = np.lexsort((grams, -counts))[:size]
    sizes = counts[order]
    first = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]])) if len(sizes) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(sizes))
    return grams[order], np.repeat((first + ends - 1) / 2, ends - first)


class Profiles:
    """Ranks of n-grams in each language; ``languages`` are in order."""

    def __init__(self, rows: dict[str, tuple[np.ndarray, np.ndarray]], depth: int = DEPTH, profile: int = PROFILE):
        self.languages, self.depth, self.profile = sorted(rows), depth, profile
        made = {k: ranked(*rows[k], depth) for k in self.languages}
        self.grams = np.unique(np.concatenate([g for g, _ in made.values()])) if made else np.zeros(0, np.int64)
        # One more row for n-grams that no language ranks.
        self.ranks = np.full((len(self.grams) + 1, len(made)), np.nan, np.float32)
        for k, (grams, ranks) in enumerate(made.values()):
            self.ranks[np.searchsorted(self.grams, grams), k] = ranks

    def distances(self, text: bytes | None) -> np.ndarray | None:
        """Mean out-of-place distance to each language, from 0 to 1; None without a letter."""
        grams, counts = gram_counts(text)
        if not len(grams) or not self.languages:
            return None
        grams, own = ranked(grams, counts, self.profile)
        own = own * (self.profile / len(grams))
        at = np.searchsorted(self.grams, grams)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] = len(self.grams)
        away = np.minimum(np.abs(self.ranks[at] - own[:, None]), self.depth)
        return np.where(np.isnan(away), self.depth, away).mean(axis=0) / self.depth

    def predict(self, text: bytes | None) -> tuple[str, float]:
        found = self.distances(text)
        if found is None:
            return UNKNOWN, 0.0
        best = int(found.argmin())
        return self.languages[best], float(1 - found[best])


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, depth: int = DEPTH, profile: int = PROFILE) -> Profiles:
    """Profiles of the languages of ``docs``, never from held-out rows."""
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    sizes = usable.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    found = sizes.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} languages")
    sizes = docs.sparkSession.createDataFrame(found, "lang string, n long")
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    picked = rows.join(F.broadcast(sizes), "lang").where(draw * F.col("n") < F.lit(per_lang << 30)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in found.items():
                grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    ship(docs.sparkSession)
    counts = picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    most = counts.withColumn("place", place).where(F.col("place") <= depth).select("lang", "gram", "n").toPandas()
    return Profiles({k: (g["gram"].to_numpy(), g["n"].to_numpy()) for k, g in most.groupby("lang")}, depth, profile)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(texts: list[bytes | None]) -> dict[str, list]:
        found = [shared.value.predict(t) for t in texts]
        return {"lang_pred": [k for k, _ in found], "score": [s for _, s in found]}

    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return with_arrow_columns(docs, text_col, added, run, keep)
