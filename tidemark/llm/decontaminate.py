"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``window`` consecutive words of a benchmark item (an item of
fewer words is one window) is a pattern of the automaton. Texts are normalised
byte by byte (A-Z lowered, every other ASCII byte outside 0-9 and a-z is a
separator), words are joined by single spaces and the automaton scans that
string once. Match ends are mapped back through the word index to byte offsets
of the original text.

The items are the stated side. Spark cuts them into pieces of at most
``PIECE_WORDS`` windows (a very long item is several), sums their pattern bytes
(no trie has more nodes than that) and deals the pieces into parts of about
``part_bytes``. One part is the usual case: one automaton, one lazy pass, no
shuffle. A larger benchmark costs passes and not memory: the documents are written
once with running numbers, then part after part is brought to the driver, broadcast,
scanned and removed again, and only rows with hits are written between passes;
hits are put together by running number at the end.

Defined results: null and wordless texts have no words and no hits; items without
text or words never occur; items without an id occur like others and count
as one item, which the digest does not list; rows with one item id are one item; equal
windows of several items count for each of them; repeated rows are independent;
an empty benchmark marks nothing; very long texts are scanned whole, their words
held as a list; input columns named like an added one are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship, with_arrow_columns, written

WINDOW = 10
PART_BYTES = 4 << 20
PIECE_WORDS = 2048
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)
_RUN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]), False)
_HITS = T.StructType([T.StructField("runs", _RUN), T.StructField("items", T.ArrayType(T.StringType()))])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", _SPAN),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def windows(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


_built: list = [None, None]


def _automaton(patterns: dict[bytes, tuple[str | None, ...]]):
    """The automaton of one part; a worker process builds it once."""
    import ahocorasick

    if _built[0] is not patterns:
        made = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            made.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, items))
        if patterns:
            made.make_automaton()
        _built[:] = [patterns, made if patterns else None]
    return _built[1]


def scan(text: bytes | None, automaton) -> tuple[int, list[tuple[int, int]], set[str | None]]:
    """(number of words, hit words as runs (first, last), items that occur)."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), [], set()
    found: dict[int, int] = {}
    items: set[str | None] = set()
    for end, (n, who) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
        found[end] = max(n, found.get(end, 0))
        items.update(who)
    if not found:
        return len(words), [], items
    ends = sorted(found)
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # the space that follows each word
    last = np.searchsorted(after, ends).tolist()
    return len(words), merged([(w - found[e] + 1, w) for w, e in zip(last, ends, strict=True)]), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjacent runs as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in the original text at which words start and end."""
    inside = np.frombuffer(text.translate(_WORD), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(item, piece, words, bytes) of the items: runs of at most PIECE_WORDS windows, their
    words joined by spaces, and the bytes of their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"item": [], "piece": [], "words": [], "bytes": []}
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    part = words[at : at + PIECE_WORDS + window - 1]
                    out["item"].append(item)
                    out["piece"].append(at)
                    out["words"].append(b" ".join(part))
                    out["bytes"].append(sum(map(len, windows(part, window))))
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["piece"], pa.int64()), pa.array(out["words"], pa.binary()), pa.array(out["bytes"], pa.int64())], names=list(out))

    ship(items.sparkSession)
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item string, piece long, words binary, bytes long")


def _patterns(part: DataFrame, window: int) -> dict[bytes, tuple[str | None, ...]]:
    """Patterns of one part, whose bytes are bounded, and the items of each."""
    found: dict[bytes, set[str | None]] = {}
    for row in part.select("item", "words").toLocalIterator():
        for w in windows(bytes(row["words"]).split(), window):
            found.setdefault(w, set()).add(row["item"])
    return {w: tuple(sorted(who, key=lambda i: (i is None, i))) for w, who in found.items()}


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_hit, n_items, items_sha256, contaminated, spans
    (UTF-8 byte offsets of the hit passages in the original text)."""
    keep = docs.columns if keep is None else keep
    cut = written(pieces(items, item_col, item_text_col, window), "pieces")
    parts = max(1, -(-(cut.agg(F.sum("bytes")).first()[0] or 0) // part_bytes))
    context = docs.sparkSession.sparkContext
    if parts == 1:
        shared = context.broadcast(_patterns(cut, window))

        def scanned(texts: list[bytes | None]) -> dict[str, list]:
            automaton = _automaton(shared.value)
            return _summed(texts, [scan(t, automaton) for t in texts])

        return with_arrow_columns(docs, text_col, RESULT, scanned, keep)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "documents")
    hits = [_hits(rows, cut.where(F.pmod(F.xxhash64("item", "piece"), F.lit(parts)) == k), window) for k in range(parts)]
    # Parts meet on rows with hits only: at most one list of runs and of items from each part.
    merged_ = reduce(DataFrame.unionByName, hits).groupBy("at").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    joined = rows.join(merged_, "at", "left").select("row", "text", "runs", "items")

    def put_together(texts: list[bytes | None], runs: list, items_: list) -> dict[str, list]:
        found = [(len(words_of(t)), merged([tuple(x.values()) for x in r or []]), set(i or [])) for t, r, i in zip(texts, runs, items_, strict=True)]
        return _summed(texts, found)

    done = with_arrow_columns(joined, "text", RESULT, put_together, ["row"], ["runs", "items"])
    names = [f.name for f in RESULT.fields]
    return done.select(*(f"row.{c}" for c in keep if c not in names), *names)


def _hits(rows: DataFrame, part: DataFrame, window: int) -> DataFrame:
    """(at, runs, items) of the rows that one part's automaton hits, written."""
    shared = rows.sparkSession.sparkContext.broadcast(_patterns(part, window))

    def scanned(texts: list[bytes | None]) -> dict[str, list]:
        automaton = _automaton(shared.value)
        found = [scan(t, automaton) for t in texts]
        return {"runs": [[{"first": a, "last": b} for a, b in runs] for _, runs, _ in found], "items": [list(items) for _, _, items in found]}

    try:
        return written(with_arrow_columns(rows, "text", _HITS, scanned, ["at"]).where(F.size("runs") > 0), "hits")
    finally:
        shared.destroy()


def _summed(texts: list[bytes | None], found: list[tuple[int, list[tuple[int, int]], set[str | None]]]) -> dict[str, list]:
    out: dict[str, list] = {f.name: [] for f in RESULT.fields}
    for text, (n, runs, items) in zip(texts, found, strict=True):
        spans = []
        if runs:
            starts, ends = _word_bounds(text)
            spans = [{"start": int(starts[a]), "end": int(ends[b])} for a, b in runs]
        hit = sum(b - a + 1 for a, b in runs)
        out["n_words"].append(n)
        out["n_hit"].append(hit)
        out["n_items"].append(len(items))
        out["items_sha256"].append(hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest())
        out["contaminated"].append(hit > 0)
        out["spans"].append(spans)
    return out
