"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. In suffix order, the longest previous factor of a
suffix is the longer of what it shares with the previous and with the next
suffix of a smaller document (``previous_factors``, capped at LENGTH): where it reaches
LENGTH, that string has an earlier match.

The suffixes are not sorted as one array. Every window of LENGTH bytes holds an
anchor: a place where the hash of ``GRAM`` bytes is the smallest of the window.
Equal windows have the same anchor at the same offset, so a suffix only needs
to meet suffixes with its anchor, about one place in 16 bytes. Documents are
dealt into blocks of about ``BLOCK_BYTES`` and three rounds follow.

1. Each block sends the keys (hashes of 48 bits) of its anchors, one row of two numbers
   for each, and Spark groups them: those in two blocks, or two documents of one, are
   told to the blocks that have them.
2. Each block sends the surroundings of such anchors, as far as their windows reach,
   each distinct one once with its smallest document: copies collapse before the shuffle. Grouped by anchor, the
   suffixes are sorted and their previous factors computed. An anchor in more
   than ``HOT`` places sends its distinct windows instead, grouped by the window
   itself and sorted by document: the first row of each is the earliest, so
   neither a common anchor nor a common passage has to be held in a task.
3. Each block marks the bytes, and hashes and returns what remains.

The texts move once, into a table bucketed by block; the rounds move rows whose
number grows with the texts and with nothing else: an anchor hash a round 1 row, a
distinct surrounding a round 2 row. No step needs more partitions, or larger
ones, as blocks grow in number.

Memory: a task holds one block: measured, 7 times its bytes where a fifth of it is
repeated elsewhere and 25 times where all of it is. A document longer than
BLOCK_BYTES is a block's part of its own size: its digest needs all its bytes in order.

Defined results: null texts are empty, texts shorter than LENGTH stay whole; a null
id counts as larger than every id; rows with one id do not remove from each
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, ship, written

LENGTH = 50
GRAM = 20
SPREAD = LENGTH - GRAM  # an anchor's offset in a window: 0 .. SPREAD
SIDE = LENGTH + SPREAD  # bytes around an anchor that its windows cover
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 128 << 10
HOT = 4096
MOST_BUCKETS = 1 << 16  # Spark refuses more than 100,000
KEY_BITS = 48
PLACES = (1 << 15) - 1  # what fits beside the block in a row of round 1
LAST = np.iinfo(np.int64).max
_P = np.array([0x9E3779B97F4A7C15], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, parts = {1: _P}, {1: data.astype(np.uint64) + np.uint64(1)}
    w = 1
    while 2 * w <= GRAM:
        h = parts[w]
        parts[2 * w] = h[:-w] * powers[w] + h[w:]
        powers[2 * w] = powers[w] * powers[w]
        w *= 2
    out, at = parts[w][:n].copy(), w
    for w in sorted(parts, reverse=True):
        while at + w <= GRAM:
            out *= powers[w]
            out += parts[w][at : at + n]
            at += w
    return _mixed(out)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    w = 1
    while 2 * w <= width:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


class Block:
    """Documents of one block and their anchors."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_pylist()
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        lengths = np.fromiter(map(len, self.texts), np.int64, len(order))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.doc_ids = np.array([LAST if i is None else i for i in self.ids], np.int64)

    def anchors(self, masks: bool) -> None:
        """pos, hash and doc of each anchor; with ``masks`` also the offsets o
        (bits) such that the window from pos - o has this anchor."""
        pos, hashes, bits, i = [], [], [], 0
        while i < len(self.ids):
            j = i + 1
            while j < len(self.ids) and self.ends[j - 1] - self.starts[i] < CHUNK_BYTES:
                j += 1
            # A long document is one chunk; pieces of it overlap by what windows and anchors reach.
            base, stop = int(self.starts[i]), int(self.ends[j - 1])
            step = CHUNK_BYTES * 4
            for at in range(base, max(stop - LENGTH + 1, base), step):
                upto = min(at + step, stop - LENGTH + 1)  # windows of this piece: at .. upto
                if upto > at:
                    self._piece(at, upto, i, j, masks, pos, hashes, bits)
            i = j
        self.pos = np.concatenate(pos) if pos else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        if masks:
            self.mask = np.concatenate(bits) if bits else np.zeros(0, np.uint32)
        self.doc = np.searchsorted(self.ends, self.pos, side="right")

    def _piece(self, at, upto, i, j, masks, pos, hashes, bits) -> None:
        h = gram_hashes(self.data[at : upto + LENGTH - 1])
        m = _slide(h, SPREAD + 1, np.minimum)
        whole = np.ones(upto - at, bool)
        for e in self.ends[i:j]:
            a, b = max(int(e) - LENGTH + 1, at) - at, min(int(e), upto) - at
            if b > a:
                whole[a:b] = False
        m = np.where(whole, m, np.uint64(0))
        room = np.zeros(SPREAD, np.uint64)
        padded = np.concatenate([room, m, room])
        here = np.flatnonzero((_slide(padded, SPREAD + 1, np.maximum) == h) & (h != 0))
        pos.append(here + at)
        hashes.append(_mixed(h[here]))  # minima are small numbers; owners are ranges of all
        if masks:
            got = np.zeros(len(here), np.uint32)
            for o in range(SPREAD + 1):
                got |= (padded[here + SPREAD - o] == h[here]).astype(np.uint32) << np.uint32(o)
            bits.append(got)

    def keys(self) -> np.ndarray:
        """KEY_BITS of each anchor's hash. More anchors than stand elsewhere may seem to: round 2 compares bytes."""
        return (self.hash >> np.uint64(64 - KEY_BITS)).astype(np.int64)

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys, and for each 2 * places (as far as PLACES) and 1 if in several documents."""
        distinct, which = np.unique(self.keys(), return_inverse=True)
        low = np.full(len(distinct), LAST, np.int64)
        high = np.full(len(distinct), np.iinfo(np.int64).min, np.int64)
        np.minimum.at(low, which, self.doc_ids[self.doc])
        np.maximum.at(high, which, self.doc_ids[self.doc])
        return distinct, 2 * np.minimum(np.bincount(which, minlength=len(distinct)), PLACES) + (low < high)

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """SIDE bytes from SPREAD before each place; zeros outside the document."""
        room = np.zeros(SPREAD, np.uint8)
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([room, self.data, np.zeros(SIDE, np.uint8)]), SIDE)
        out = view[self.pos[at]]
        doc, where = self.doc[at], self.pos[at]
        near = np.flatnonzero((where - self.starts[doc] < SPREAD) | (self.ends[doc] - where < LENGTH))
        for k in near:
            before = self.starts[doc[k]] - where[k] + SPREAD
            after = self.ends[doc[k]] - where[k] + SPREAD
            if before > 0:
                out[k, :before] = 0
            if after < SIDE:
                out[k, after:] = 0
        return out


def _row_hashes(rows: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each row of bytes."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(np.uint64)
    out = np.full(len(rows), salt + 1, np.uint64)
    for k in range(words.shape[1]):
        out = _mixed(out ^ words[:, k]) + np.uint64(k)
    return out


def _distinct(rows: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct row, which of those each row is).

    Rows are grouped by hash and compared byte by byte with their first; the
    order is that of the hash and so the same in every run."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _row_hashes(rows, salt)
    order = np.argsort(h, kind="stable")
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    first = order[fresh]
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(fresh) - 1
    if not np.array_equal(rows[first[which]], rows):
        return _distinct(rows, salt + 1)
    return first, which


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 if there is none.

    What lies between an index and its pointer is never smaller, so pointers may
    jump along pointers; runs without a smaller value are passed by doubling."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def previous_factors(heads: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, as far as its head (a row of bytes) goes:
    what it shares with the nearest suffixes, before and after it in suffix order,
    of a smaller document."""
    n, width = heads.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out
    order = np.argsort(np.ascontiguousarray(heads).view(f"V{width}").ravel(), kind="stable")
    rank = np.unique(doc[order], return_inverse=True)[1]
    after = n - 1 - previous_smaller(rank[::-1])[::-1]
    for near in (previous_smaller(rank), np.where(after == n, -1, after)):
        has = np.flatnonzero(near >= 0)
        differs = heads[order[has]] != heads[order[near[has]]]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        out[order[has]] = np.maximum(out[order[has]], shared)
    return out


_ANCHORS = "key long, at long"
_TOLD = "block long, kind int, item long, bits int"
_SENT = "kind int, hash long, block int, item int, around binary, mask int, low long"
_OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
TOLD, COLD, WINDOW = 0, 1, 2  # kinds of rows: a shared hash; surroundings of an anchor; a window of a hot one


def _table(schema: str, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(",")]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary array whose values all have ``width`` bytes, as rows of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + len(column) * width].reshape(-1, width)


def _anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    block = Block(table)
    block.anchors(masks=False)
    distinct, found = block.distinct_keys()
    return _table(_ANCHORS, [distinct, key[0].as_py() * 2 * (PLACES + 1) + found])


class Asked:
    """What a block sends in round 2, in an order that round 3 finds again."""

    def __init__(self, block: Block, told: pa.Table):
        block.anchors(masks=True)
        self.block = block
        rows = told.filter(pc.equal(told.column("kind"), TOLD))
        known = rows.column("item").to_numpy()
        order = np.argsort(known)
        known, hot, keys = known[order], rows.column("bits").to_numpy()[order], block.keys()
        flag = np.zeros(len(keys), np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            flag = np.where(known[near] == keys, 1 + hot[near], 0)
        # Surroundings of the anchors that stand elsewhere too, each distinct one once.
        self.at = np.flatnonzero(flag > 0)
        self.docs = block.doc_ids[block.doc[self.at]]
        around = np.concatenate([_clipped(block.surroundings(self.at), block.mask[self.at]), block.mask[self.at].reshape(-1, 1).view(np.uint8).reshape(-1, 4)], axis=1)
        first, self.entry = _distinct(around)
        self.around = around[first]
        self.mask = block.mask[self.at][first]
        self.hash = block.hash[self.at][first]
        self.low = np.full(len(first), LAST, np.int64)
        np.minimum.at(self.low, self.entry, self.docs)
        is_hot = flag[self.at][first] == 2
        self.cold, self.hot = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        # Of hot anchors, the distinct windows.
        at, self.offset = _bits(self.mask[self.hot])
        self.hot_entry = self.hot[at]
        windows = np.lib.stride_tricks.sliding_window_view(self.around[:, :SIDE], LENGTH, axis=1)[self.hot_entry, SPREAD - self.offset]
        first, self.window = _distinct(windows)
        self.windows = windows[first]
        self.window_low = np.full(len(first), LAST, np.int64)
        np.minimum.at(self.window_low, self.window, self.low[self.hot_entry])

    def earlier(self, told: pa.Table) -> np.ndarray:
        """Offsets (bits), for each place in ``at``, whose windows an earlier document has."""
        entries = np.zeros(len(self.low), np.uint32)
        answer = told.filter(pc.equal(told.column("kind"), COLD))
        entries[self.cold[answer.column("item").to_numpy()]] = answer.column("bits").to_numpy().view(np.uint32)
        seen = np.zeros(len(self.windows), bool)
        seen[told.filter(pc.equal(told.column("kind"), WINDOW)).column("item").to_numpy()] = True
        known = seen[self.window] | (self.low[self.hot_entry] > self.window_low[self.window])
        np.bitwise_or.at(entries, self.hot_entry[known], np.uint32(1) << self.offset[known].astype(np.uint32))
        return np.where(self.docs > self.low[self.entry], self.mask[self.entry], entries[self.entry])


def _bits(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, offset) of each bit that is set."""
    at, offset = [], []
    for o in range(SPREAD + 1):
        got = np.flatnonzero((masks >> np.uint32(o)) & np.uint32(1))
        at.append(got)
        offset.append(np.full(len(got), o, np.int64))
    return np.concatenate(at), np.concatenate(offset)


def _clipped(around: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Surroundings with zeros where none of their windows reaches: that does not tell them apart."""
    first, last = np.floor(np.log2(masks & -masks.astype(np.int64))), np.floor(np.log2(masks))
    place = np.arange(SIDE)
    within = (place >= (SPREAD - last)[:, None]) & (place < (SPREAD - first + LENGTH)[:, None])
    return np.where(within, around, np.uint8(0))


def _send(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
    if not texts.num_rows or not told.num_rows:
        return _table(_SENT, [[]] * 7)
    asked = Asked(Block(texts), told)
    sent = []
    for kind, hashes, around, masks, low in (
        (COLD, asked.hash[asked.cold], asked.around[asked.cold, :SIDE], asked.mask[asked.cold], asked.low[asked.cold]),
        (WINDOW, _row_hashes(asked.windows), asked.windows, np.zeros(len(asked.windows), np.uint32), asked.window_low),
    ):
        n = len(hashes)
        sent.append(_table(_SENT, [np.full(n, kind, np.int32), hashes.view(np.int64), np.full(n, key[0].as_py(), np.int32), np.arange(n, dtype=np.int32), _bytes(around), masks.view(np.int32), low]))
    return pa.concat_tables(sent)


def _earlier_offsets(around: np.ndarray, mask: np.ndarray, low: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For surroundings sorted by anchor, the offsets (bits) whose windows have an earlier match."""
    fresh = np.ones(len(around), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (mask[1:] != mask[:-1]) | (around[1:] != around[:-1]).any(axis=1)
    first, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    # An anchor with one surrounding has no other suffixes to meet.
    kind = np.cumsum(np.concatenate([[True], hashes[first][1:] != hashes[first][:-1]])) - 1
    several = first[np.bincount(kind)[kind] > 1]
    at, offset = _bits(mask[several])
    own = several[at]
    windows = np.lib.stride_tricks.sliding_window_view(around, LENGTH, axis=1)[own, SPREAD - offset]
    repeated = previous_factors(windows, low[own]) >= LENGTH
    bits = np.zeros(len(around), np.uint32)
    np.bitwise_or.at(bits, own[repeated], np.uint32(1) << offset[repeated].astype(np.uint32))
    # Rows with one surrounding are sorted by document: all of it is repeated in all but the first.
    return np.where(low > low[first][which], mask, bits[first][which])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for rows sorted by kind, hash, bytes, mask and document: surroundings by
    whole anchors (fewer than HOT places each), windows as they come."""
    carry: pa.RecordBatch | None = None
    last: tuple[bytes, int] = (b"", 0)

    def told(batch: pa.RecordBatch, kind: int, bits: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(bits)
        block, item = (batch.column(c).to_numpy()[some] for c in ("block", "item"))
        table = _table(_TOLD, [block.astype(np.int64), np.full(len(some), kind, np.int32), item.astype(np.int64), bits[some].view(np.int32)])
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)

    def cold(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask, low, hashes = batch.column("mask").to_numpy().view(np.uint32), batch.column("low").to_numpy(), batch.column("hash").to_numpy()
        return told(batch, COLD, _earlier_offsets(_rows(batch.column("around"), SIDE), mask, low, hashes))

    for whole in batches:
        kinds = whole.column("kind").to_numpy()
        cut = int(np.searchsorted(kinds, WINDOW))
        batch, windows = whole.slice(0, cut), whole.slice(cut)
        if batch.num_rows:
            if carry is not None:
                batch = pa.concat_batches([carry, batch])
            hashes = batch.column("hash").to_numpy()
            end = int(np.searchsorted(hashes, hashes[-1])) if not windows.num_rows else len(hashes)
            carry = batch.slice(end)
            if end:
                yield cold(batch.slice(0, end))
        if windows.num_rows:
            if carry is not None and carry.num_rows:
                yield cold(carry)
            carry = None
            rows, low = _rows(windows.column("around"), LENGTH), windows.column("low").to_numpy()
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            fresh[0] = rows[0].tobytes() != last[0]
            least = np.concatenate([[last[1]], low[fresh]])[np.cumsum(fresh)]
            last = (rows[-1].tobytes(), int(least[-1]))
            yield told(windows, WINDOW, (low > least).astype(np.int32))
    if carry is not None and carry.num_rows:
        yield cold(carry)


def _covered(start: np.ndarray) -> np.ndarray:
    """The bytes within LENGTH of a start, by doubling."""
    out, reach = start.copy(), 1
    while reach < LENGTH:
        step = min(reach, LENGTH - reach)
        out[step:] |= out[:-step].copy()
        reach += step
    return out


def _finish(with_text: bool):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table(_OUT, [[]] * 6)
        block = Block(texts)
        start = np.zeros(len(block.data), bool)
        if told.num_rows:
            asked = Asked(block, told)
            mask = asked.earlier(told)
            for o in range(SPREAD + 1):
                start[block.pos[asked.at[(mask >> np.uint32(o)) & np.uint32(1) == 1]] - o] = True
        removed = _covered(start)
        out: list[list] = [[] for _ in range(6)]
        for i, (a, b) in enumerate(zip(block.starts, block.ends, strict=True)):
            gone = removed[a:b]
            n = int(gone.sum())
            kept = block.data[a:b][~gone].tobytes() if n else block.texts[i]
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
            for column, value in zip(out, (block.ids[i], int(b - a), n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                column.append(value)
        return _table(_OUT, out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT, with_text: bool = True, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked for, ``kept``: the remaining bytes."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows of one id are spread by their text, too.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(blocks)).cast("long"))
    name = f"tidemark_blocks_{uuid.uuid4().hex}"
    # A bucket is one block, or beyond ``most_buckets`` several, which are groups within it.
    buckets = min(blocks, most_buckets)
    dealt.repartition(buckets, "block").write.option("path", new_path(spark, "blocks")).option("compression", "zstd").bucketBy(buckets, "block").format("parquet").saveAsTable(name)
    texts = spark.table(name)
    anchors = texts.groupBy("block").applyInArrow(_anchors, _ANCHORS)
    told = written(_shared(anchors, hot), "shared-anchors")
    sent = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send, _SENT)
    sent = sent.repartition("hash").sortWithinPartitions("kind", "hash", "around", "mask", "low")
    answers = sent.mapInArrow(_answer, _TOLD)
    done = texts.groupBy("block").cogroup(told.union(answers).groupBy("block")).applyInArrow(_finish(with_text), _OUT)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    # The result reads the table's files; its name is needed for the plan alone.
    out = done.select(F.col("id").alias(id_col), *columns)
    spark.sql(f"DROP TABLE {name}")
    return out


def _shared(anchors: DataFrame, hot: int) -> DataFrame:
    """The anchors that stand in two blocks, or documents of one, or more, for each of their blocks."""
    # A key has at most one row of two numbers a block; Spark spills a long run of them.
    same = Window.partitionBy("key")
    found = F.col("at") % (2 * (PLACES + 1))
    rows = anchors.select("key", "at", F.count("*").over(same).alias("n"), F.max(found % 2).over(same).alias("several"), F.sum(F.floor(found / 2)).over(same).alias("places"))
    rows = rows.where((F.col("n") > 1) | (F.col("several") > 0))
    return rows.select(F.floor(F.col("at") / (2 * (PLACES + 1))).cast("long").alias("block"), F.lit(TOLD).alias("kind"), F.col("key").alias("item"), (F.col("places") >= hot).cast("int").alias("bits"))
