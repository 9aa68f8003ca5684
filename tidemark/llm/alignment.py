"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE (a JSON file), B a sentencepiece BPE with byte fallback;
their files are parameters, read by the driver and broadcast (some 2 MB). A encodes a space
and the text, B the text, to which it adds that space. ``mapInArrow`` cuts a partition into
chunks of about ``CHUNK_BYTES`` of text and merges the two running sums of token lengths
of a chunk: where both end, a group ends; between two ends of either, one token of A and
one of B overlap, which is a link. A chunk gives one row for each document (counts, digest,
and how often it holds which pair of ids, as indices into the chunk's own list of pairs) and
that list with its counts. Spark sums the counts of the pairs, takes each id's maximum,
joins both back to the lists, and each chunk adds up its documents. What is shuffled
are distinct pairs of chunks, not links, and then once the documents' rows by chunk.

Bounds: a chunk holds about a million links or one document; a document is tokenized whole and needs
about 60 times its bytes. Maxima are broadcast: one row for each id of a vocabulary.

Defined results: null and empty texts, texts that are not UTF-8, and texts that the joined
bytes of a tokenizer's tokens do not give back (such as those with U+2581) have no tokens:
zeros and an empty digest; they hold no pairs. Strings of special tokens are plain text.
Repeated rows each count; an empty table gives an empty result; input columns named like
an added one are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship, written

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 60_000
WORDS = 200_000
A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# How a byte-level BPE cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes that a byte-level BPE writes as the character of the same number.
PLAIN = ((33, 126), (161, 172), (174, 255))

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_SUMS = ["n_best", "n_best_a", "count_sum"]
_TOKENS = ["a_ids", "b_ids", "a_ends", "b_ends"]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: bytes that are
    not plain follow one another from 256 on."""
    plain = [b for low, high in PLAIN for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        made, byte_of = json.loads(a_json), _byte_of()
        special = {t["content"] for t in made["added_tokens"]}
        vocab = {bytes(map(byte_of.__getitem__, k)): v for k, v in made["model"]["vocab"].items() if k not in special}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in made["model"]["merges"]]
        in_order = all(made["model"]["vocab"][x + y] == 256 + i for i, (x, y) in enumerate(merges))
        if not in_order or made["normalizer"] or made["pre_tokenizer"]["type"] != "ByteLevel" or not all(bytes([b]) in vocab for b in range(256)):
            raise ValueError("tokenizer A must be a byte-level BPE whose ids follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        a_bytes = {v: k for k, v in vocab.items()}
        self.n_a, self.n_b = max(a_bytes) + 1, len(pieces)
        self.a_len = np.array([len(a_bytes.get(i, b"")) for i in range(self.n_a)], np.int64)
        self.b_len = np.array(list(map(len, self.b_bytes)), np.int64)
        # Where no piece has a space behind another character, no merge reaches over
        # the start of a run of spaces, so that words are encoded one by one.
        self.apart = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.word = re.compile(rb" +[^ ]*+" if self.apart else rb"(?s).+")
        self.space = [self.b.piece_to_id("▁")]
        # Decimal ids with the mark that follows: "," or, at the end of a group's side, "|" or ";".
        named = [f"{i}{mark}".encode() for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]
        self.name_len = np.array(list(map(len, named)), np.int64)
        self.names = np.array(named, f"S{self.name_len.max()}").view(np.uint8).reshape(len(named), -1)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words (without the space before them), encoding those not known yet."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > WORDS:  # what is kept is bounded; a chunk's own words always are
            self._forget()
            new = words
        if new:
            found = self.b.encode([w.decode() for w in new], num_threads=1)
            found = [ids if w else self.space for w, ids in zip(new, found, strict=True)]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))])
            self.good = np.concatenate([self.good, [b"".join([self.b_bytes[i] for i in ids]) == b" " + w for w, ids in zip(new, found, strict=True)]])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of texts one after another, words in each text)."""
        plain = [self.apart and b"  " not in t and t[0] != 32 and t[-1] != 32 for t in texts]
        lists = pc.split_pattern(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_binary()), b" ")
        coded = lists.values.dictionary_encode()
        runs = iter(np.split(coded.indices.to_numpy(), lists.offsets.to_numpy()[1:-1]) if len(lists) else ())
        words = coded.dictionary.to_pylist()
        known = {w: k for k, w in enumerate(words)}
        parts = []
        for text, p in zip(texts, plain, strict=True):
            if p:
                parts.append(next(runs))
                continue
            # Only the first space of a run is the border; the others go to the word behind them.
            own = [w[1:] for w in self.word.findall(b" " + text)]
            parts.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
        numbers = self._numbers(list(known))
        return numbers[np.concatenate(parts)] if parts else np.zeros(0, np.int64), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, of B, tokens of A in each text, of B) of texts one after another."""
        rows = []
        for k, text in enumerate(texts):
            try:
                if text:
                    rows.append((k, text.decode()))
            except UnicodeDecodeError:
                pass
        at, sizes = self._words([texts[k] for k, _ in rows])
        of = np.repeat(np.arange(len(rows)), sizes)
        good = np.bincount(of, ~self.good[at], len(rows)) == 0 if len(rows) else np.zeros(0, bool)
        keep = good[of] if len(rows) else np.zeros(0, bool)
        at, of = at[keep], of[keep]
        tokens = self.sizes[at]
        shift = np.repeat(self.starts[at] - (np.cumsum(tokens) - tokens), tokens)
        b_ids = self.ids[shift + np.arange(len(shift))]
        b_n = np.zeros(len(texts), np.int64)
        number = np.array([k for k, _ in rows], np.int64)
        if len(rows):
            b_n[number] = np.bincount(of, tokens, len(rows)).astype(np.int64)
        a_n, a_ids = np.zeros(len(texts), np.int64), []
        for (k, said), fine in zip(rows, good.tolist(), strict=True):
            if fine:
                ids = self.a.encode_ordinary(" " + said)
                a_n[k] = len(ids)
                a_ids.append(np.array(ids, np.int64))
        return np.concatenate(a_ids) if a_ids else np.zeros(0, np.int64), b_ids, a_n, b_n


_built: list = [None, None]


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    """A worker process builds them once."""
    if _built[0] != files:
        _built[:] = [files, Tokenizers(*files)]
    return _built[1]


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, n).astype(np.int64) if len(of) else np.zeros(n, np.int64)


def merge(t: Tokenizers, texts: list[bytes | None], with_tokens: bool = False) -> tuple[dict[str, object], np.ndarray, np.ndarray]:
    """The columns of a chunk's documents, its pairs of ids (b * n_a + a) and their links."""
    a_ids, b_ids, a_n, b_n = t.encode(texts)
    n = len(texts)
    a_end, b_end = np.cumsum(t.a_len[a_ids]), np.cumsum(t.b_len[b_ids])
    if (a_end[-1] if len(a_end) else 0) != (b_end[-1] if len(b_end) else 0):
        raise AssertionError("both tokenizers must cover the same bytes")
    marks = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, np.uint8)
    marks[a_end] = 1
    marks[b_end] += 2
    ends = np.flatnonzero(marks)  # one link ends at each
    is_a, is_b = (marks[ends] & 1).astype(bool), (marks[ends] & 2).astype(bool)
    both = is_a & is_b
    last = np.zeros(len(a_ids), bool)
    last[np.cumsum(a_n)[a_n > 0] - 1] = True
    doc_end = np.zeros(len(ends), np.int64)
    doc_end[is_a] = last
    full = np.flatnonzero(a_n > 0)
    doc = full[np.cumsum(doc_end) - doc_end] if len(full) else np.zeros(0, np.int64)
    group = np.cumsum(both) - both
    out: dict[str, object] = {"n_a": a_n, "n_b": b_n, "n_groups": _sums(both, doc, n), "n_links": np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)}
    # Digest: the tokens of A of each group, then those of B.
    a_group, b_group, groups = group[is_a], group[is_b], int(both.sum())
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    if groups:
        order[np.arange(len(a_ids)) + (np.cumsum(in_b) - in_b)[a_group]] = a_ids + t.n_a * both[is_a]
        order[np.arange(len(b_ids)) + np.cumsum(in_a)[b_group]] = 2 * t.n_a + b_ids + t.n_b * both[is_b]
    said = t.names[order].ravel()
    said = said[said != 0].tobytes()
    width = np.concatenate([[0], np.cumsum(t.name_len[order])])
    stops = width[np.cumsum(a_n + b_n)].tolist()
    starts = [0, *stops[:-1]]
    out["groups_sha256"] = [hashlib.sha256(said[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(starts, stops, strict=True)]
    # Links of each (pair, document), by one sort.
    key = b_ids[np.cumsum(is_b) - is_b] * t.n_a + a_ids[np.cumsum(is_a) - is_a]
    held = np.sort(key.astype(np.uint64) << np.uint64(16) | doc.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(held)))
    held = held[first]
    pair, who = (held >> np.uint64(16)).astype(np.int64), (held & np.uint64(0xFFFF)).astype(np.uint16)
    new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
    index = np.cumsum(new) - 1
    by_doc = np.argsort(who, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).tolist()
    where, times_ = index[by_doc].astype(np.uint32), times[by_doc].astype(np.uint32)
    out["held"] = [where[x:y].tobytes() + times_[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
    if with_tokens:
        for name, ids, end, size in (("a", a_ids, a_end, a_n), ("b", b_ids, b_end, b_n)):
            stop = np.cumsum(size)
            before = np.concatenate([[0], end])[stop - size]
            offsets = pa.array(np.concatenate([[0], stop]), pa.int32())
            out[f"{name}_ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            out[f"{name}_ends"] = pa.ListArray.from_arrays(offsets, pa.array(end - np.repeat(before, size), pa.int32()))
    return out, pair[new], np.bincount(index, times, int(new.sum())).astype(np.int64) if len(index) else np.zeros(0, np.int64)


def _chunks_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most CHUNK_BYTES, or one row, and at most CHUNK_ROWS."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and (held + size > CHUNK_BYTES or k - start >= CHUNK_ROWS):
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _chunks(docs: DataFrame, a_file: str, b_file: str, text_col: str, keep: list[str], with_tokens: bool) -> DataFrame:
    """Rows of documents (chunk, row, counts, digest, held) and of chunks (chunk, pairs, times), written."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(a_file).read_bytes(), Path(b_file).read_bytes()))
    row = T.StructType([docs.schema[c] for c in keep] or [T.StructField("none", T.StringType())])
    longs, ints = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("row", row)]
        + [T.StructField(c, T.LongType()) for c in _COUNTS]
        + [T.StructField("groups_sha256", T.StringType()), T.StructField("held", T.BinaryType())]
        + [T.StructField(c, ints) for c in _TOKENS if with_tokens]
        + [T.StructField("pairs", longs), T.StructField("times", longs)]
    )
    arrow = to_arrow_schema(schema)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, chunk = _tokenizers(files.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("__bytes").to_pylist()
            for start, stop in _chunks_of([len(x or b"") for x in texts]):
                n = stop - start
                got, pairs, times = merge(t, texts[start:stop], with_tokens)
                got |= {"chunk": [chunk] * n, "row": batch.column("row").slice(start, n)}
                for head in (False, True):
                    one = {"chunk": [chunk], "pairs": [pairs], "times": [times]} if head else got
                    size = 1 if head else n
                    arrays = [one[f.name] if isinstance(one.get(f.name), pa.Array) else pa.array(one.get(f.name, [None] * size), f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
                chunk += 1

    source = docs.select(F.struct(*(keep or [F.lit(None).cast("string").alias("none")])).alias("row"), F.col(text_col).cast("binary").alias("__bytes"))
    return written(source.mapInArrow(run, schema), "alignment")


def _asked(chunks: DataFrame) -> DataFrame:
    """(chunk, at, pair, n) of the chunks' lists."""
    return chunks.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p")).select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))


def _counted(chunks: DataFrame, n_a: int) -> DataFrame:
    """(pair, n, best_of_a, best_of_b) over all chunks."""
    totals = written(_asked(chunks).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a, b = F.col("pair") % n_a, F.expr(f"pair div {n_a}")
    sided = totals.withColumns({"a_id": a, "b_id": b})
    # One row for each id of a vocabulary.
    most_a = sided.groupBy("a_id").agg(F.max("n").alias("most_a"))
    most_b = sided.groupBy("b_id").agg(F.max("n").alias("most_b"))
    found = sided.join(F.broadcast(most_a), "a_id").join(F.broadcast(most_b), "b_id")
    return found.select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most_a")).alias("best_of_a"), (F.col("n") == F.col("most_b")).alias("best_of_b"))


def _vocabulary(a_file: str) -> int:
    made = json.loads(Path(a_file).read_bytes())
    special = {t["content"] for t in made["added_tokens"]}
    return max(v for k, v in made["model"]["vocab"].items() if k not in special) + 1


def pair_counts(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n, best_of_a, best_of_b): links of each pair of ids over all documents, and
    whether no other pair of that id of A, or of B, has more."""
    chunks = _chunks(docs, a_file, b_file, text_col, [], False)
    return _counted(chunks, _vocabulary(a_file)).drop("pair")


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text_col: str = "text", keep: list[str] | None = None, with_tokens: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_a, n_b, n_groups, n_links, n_best and n_best_a (links
    whose pair is the most frequent of its id of B, of A), count_sum and groups_sha256; with
    ``with_tokens`` also the ids and byte ends (counted from the added space) of both sides."""
    added = [*_COUNTS, *_SUMS, "groups_sha256", *(_TOKENS if with_tokens else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    chunks = _chunks(docs, a_file, b_file, text_col, keep, with_tokens)
    counted = _counted(chunks, _vocabulary(a_file)).select("pair", F.col("n").alias("total"), "best_of_a", "best_of_b")
    back = _asked(chunks).join(counted, "pair").select(F.col("chunk").alias("of"), "at", "total", "best_of_a", "best_of_b")
    rows = chunks.where("pairs is null").drop("pairs", "times")
    kinds = {f.name: f for f in rows.schema}
    schema = T.StructType([kinds["row"], *(kinds[c] for c in _COUNTS), *(T.StructField(c, T.LongType()) for c in _SUMS), kinds["groups_sha256"], *(kinds[c] for c in _TOKENS if with_tokens)])

    def add_up(found: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs.column("at").to_numpy()
        total, best_a, best_b = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.zeros(len(at), bool)
        total[at], best_a[at], best_b[at] = pairs.column("total").to_numpy(), pairs.column("best_of_a").to_numpy(), pairs.column("best_of_b").to_numpy()
        sums: dict[str, list[int]] = {c: [] for c in _SUMS}
        for held in found.column("held").to_pylist():
            where, times = np.frombuffer(held, np.uint32).reshape(2, -1).astype(np.int64)
            sums["n_best"].append(int(times[best_b[where]].sum()))
            sums["n_best_a"].append(int(times[best_a[where]].sum()))
            sums["count_sum"].append(int((times * total[where]).sum()))
        columns = {c: pa.array(sums[c], pa.int64()) if c in sums else found.column(c) for c in schema.names}
        return pa.table(columns)

    done = rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add_up, schema)
    return done.select(*(f"row.{c}" for c in keep), *added)
