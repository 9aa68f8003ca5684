"""SimHash fingerprints, near-duplicate links by pigeonring filtering, components.

A fingerprint has 64 bits. The bits stand on a ring of ``SEGMENTS``
consecutive segments. If two fingerprints differ in at most ``tau`` bits, some
segment starts a chain in which, for every length l, the first l segments
differ in at most ``l * tau / SEGMENTS`` bits (cycle lemma on the ring). With
tau = 4 on 9 segments the first two segments of that chain are equal and the
next two hold at most one differing bit, so one of those is equal too: chain
start, and which of the two, make 18 keys of about 21 bits. Fingerprints meet
on equal keys, are pruned by the whole chain condition and only then compared
in full.

Cost: one Python pass over the texts (no shuffle), one shuffle of 18 small keys
for each *distinct* fingerprint, then joins of linked fingerprints only. Copies
share a fingerprint, so a group of copies is one row before anything is
shuffled by key. A bucket never lists all its pairs: it returns a spanning
forest of its links. Buckets of more than ``BUCKET_ROWS`` fingerprints are
compared in blocks, then by the roots of the blocks' trees, and only if that leaves
several trees in pairs of blocks: no task holds an unbounded group, and a large
group of near copies costs what its size is.

Fingerprints within 4 bits are a far tighter bond than likeness 0.8 of 5-word
shingles. ``keep_unlike`` is the operator's mode for a pipeline's stage: distinct
shingle sets meet where pigeonring filtering links their fingerprints, and, for pairs
beyond its radius, on equal bands of MinHash values; what meets is compared by exact
Jaccard likeness (again a spanning forest, again in blocks), and
components follow as above. ``BANDS`` bands of ``BAND_ROWS`` values meet a pair of
likeness 0.8 with probability 0.9998 and one of 0.85 with 0.999995; below 0.8 no
pair is linked. Only the keys are grouped; sets that meet none, but for a few that a
bit table of ``MEETING_BITS`` bits mistakes, do not move, others move to their buckets. Buckets of the same members are compared once. Null and wordless
texts are alike; one row of each component stays, that of the smallest id, nulls
last, then of the smallest running number, so repeated and missing ids need no
other rule. Copies are one row a shingle set before anything meets by component.

Defined results: null and wordless texts have fingerprint 0 and link like any
other; texts of fewer words than a shingle are hashed whole; repeated doc_ids
are separate rows with one component; a null id is larger than every id, and a
component without any id has component_id null; texts with very many shingles are hashed
whole, in blocks; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import join_by_size, ship, with_arrow_columns, written
from tidemark.operators.graph import components

SEED = 42
SEGMENTS = 9
BUCKET_ROWS = 1 << 11
BLOCK = 1 << 16
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BANDS = 16
BAND_ROWS = 4
SET_BLOCK = 1 << 18
SET_ROWS = 1 << 9
MEETING_BITS = 1 << 23
_TURNS = np.random.default_rng(SEED).integers(1, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text; shingle repeats count."""
    tokens = [w for w in _SPACES.split((text or b"").translate(_ASCII_LOWER)) if w]
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """(id, fp), or the columns ``keep`` with fp: the fingerprint as a signed long."""

    def run(texts: list[bytes | None]) -> dict[str, list]:
        return {name: np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return with_arrow_columns(docs, text_col, T.StructType([T.StructField(name, T.LongType())]), run, [id_col] if keep is None else keep)


def _edges(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of the 64 bits."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_keys(fp: Column, tau: int = 4, segments: int = SEGMENTS) -> Column:
    """Array of bucket keys: equal on the exact head of a chain and on all but
    ``budget`` of the following segments, up to where the budget grows again."""
    if not 0 <= tau < segments:
        raise ValueError("tau must be below the number of segments")
    budget = [(length * tau) // segments for length in range(segments + 1)]
    head = max((n for n in range(1, segments + 1) if budget[n] == 0), default=0)
    whole = max(n for n in range(1, segments + 1) if budget[n] <= 1)
    parts = _edges(segments)
    keys, slot = [], 0
    for start in range(segments):
        exact = [(start + j) % segments for j in range(head)]
        tail = [(start + j) % segments for j in range(head, whole)]
        for spared in tail or [None]:
            used = exact + [s for s in tail if s != spared]
            value, width = F.lit(0).cast("long"), 0
            for s in used:
                shift, bits = parts[s]
                piece = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
                value = value.bitwiseOR(F.shiftleft(piece, width))
                width += bits
            if width > 55:
                value = F.xxhash64(value)
            keys.append(F.xxhash64(F.lit(slot), value) if width > 55 else value.bitwiseOR(F.lit(slot << 56).cast("long")))
            slot += 1
    return F.array(*keys)


def _passes_ring(x: np.ndarray, tau: int, segments: int) -> np.ndarray:
    """Does some chain of each xor keep all its proportional budgets?"""
    counts = np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in _edges(segments)]).astype(np.int64)
    total = np.zeros_like(counts)
    good = np.ones(counts.shape, bool)
    for length in range(1, segments + 1):
        total = total + np.roll(counts, -(length - 1), axis=0)
        good &= total * segments <= length * tau
    return good.any(axis=0)


def _linked(x: np.ndarray, tau: int, segments: int) -> np.ndarray:
    ok = _passes_ring(x, tau, segments)
    ok[ok] = np.bitwise_count(x[ok]) <= tau
    return ok


def _forest(fps: np.ndarray, tau: int, segments: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links in one bucket, by breadth-first search, and a loop
    (a node linked to itself) at the root of each tree.

    Each step compares one fingerprint with those not reached yet, so a dense
    group costs little more than its size."""
    left, right = [], []
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        left.append(queue[0])
        right.append(queue[0])
        while queue and len(rest):
            at = queue.pop()
            near = _linked(fps[rest] ^ fps[at], tau, segments)
            hit = rest[near]
            left += [at] * len(hit)
            right += hit.tolist()
            queue += hit.tolist()
            rest = rest[~near]
    return left, right


def _bucket_links(tau: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None

        def links(key, pair, fp, node):
            bounds = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(key)]])
            sizes = ends - starts
            one, two = starts[sizes == 1], starts[sizes == 2]
            ok = _linked(fp[two] ^ fp[two + 1], tau, segments)
            # Roots: single nodes, first nodes of twos, and second ones that are not linked.
            a, b = [node[one], node[two], node[two]], [node[one], node[two], np.where(ok, node[two + 1], node[two])]
            a.append(node[two[~ok] + 1])
            b.append(node[two[~ok] + 1])
            of = [key[one], key[two], key[two], key[two[~ok]]]
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                left, right = _forest(fp[s:e], tau, segments)
                a.append(node[s:e][left])
                b.append(node[s:e][right])
                of.append(key[s:e])  # as many links and loops as nodes
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pair", "fp", "node")]
            cols[2] = cols[2].view(np.uint64)
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            carry = [c[cut:] for c in cols]
            if cut:
                yield links(*[c[:cut] for c in cols])
        if carry is not None and len(carry[0]):
            yield links(*carry)

    return run


def _meet(members: DataFrame, compare, room: int) -> DataFrame:
    """(a, b) with a < b: links that connect, in every bucket, what all its links connect.

    ``members`` (key, node, size, blocks and what ``compare`` needs), written, in buckets of
    ``blocks`` blocks; ``compare`` takes members with their ``pair`` and returns (key, a, b), a
    spanning forest of each (key, pair) with loops at its roots.

    A block is compared alone first. Of a bucket of several blocks, the roots follow
    if they fit into ``room``; where they form one tree, as in a large group of near
    copies, the whole bucket is connected, for a cost in proportion to it. Only what is
    left is compared in pairs of blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    first = written(compare(members.withColumn("pair", own)), "block-links")
    parts, large = [first], members.where("blocks > 1")
    if not large.isEmpty():
        roots = first.where("a = b").select("key", F.col("a").alias("node"))
        top = written(large.join(roots, ["key", "node"], "left_semi"), "roots")
        fits = top.groupBy("key").agg(F.sum("size").alias("all")).where(F.col("all") <= room).select("key")
        second = written(compare(top.join(fits, "key").withColumn("pair", F.lit(0))), "root-links")
        whole = second.where("a = b").groupBy("key").agg(F.count("*").alias("trees")).where("trees = 1").select("key")
        rest = large.join(written(whole, "connected"), "key", "left_anti")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
        parts += [second, compare(rest.withColumn("pair", F.explode(F.filter(pairs, lambda p: p % F.col("blocks") != F.floor(p / F.col("blocks"))))))]
    return reduce(DataFrame.union, parts).where("a < b").select("a", "b").distinct()


def links(nodes: DataFrame, tau: int = 4, segments: int = SEGMENTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) with a < b: links that connect the same nodes as all links do.

    ``nodes`` has one row for each distinct fingerprint: fp and node, a long
    that tells it apart."""
    ship(nodes.sparkSession)
    keyed = nodes.select("fp", "node", F.explode(chain_keys(F.col("fp"), tau, segments)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > bucket_rows).select("key", "count", F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks"))
    large = written(large, "large-buckets")

    def compare(asked: DataFrame) -> DataFrame:
        dealt = asked.select("key", "pair", "fp", "node").repartition("key", "pair").sortWithinPartitions("key", "pair")
        return dealt.mapInArrow(_bucket_links(tau, segments), "key long, a long, b long")

    members = keyed.join(large, "key", "left").select("key", "node", "fp", F.lit(1).alias("size"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    if large.isEmpty():
        return compare(members.withColumn("pair", F.lit(0))).where("a < b").select("a", "b").distinct()
    return _meet(written(members, "bucket-members"), compare, bucket_rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, tau: int = 4, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (smallest id reachable by links)."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    lowest = written(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    comps = components(links(lowest.select("fp", F.col("fp").alias("node")), tau, segments), "simhash-links")
    linked = written(lowest.join(comps, F.col("fp") == F.col("node")).select("fp", "low", "n", F.col("component").alias("root")), "linked")
    smallest = written(linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")), "roots")
    named = join_by_size(linked, smallest, ["root"], "members", linked.count()).select("fp", "n", "component_id")
    alone = lowest.join(linked, "fp", "left_anti").select("fp", "n", F.col("low").alias("component_id"))
    named = written(named.unionByName(alone), "components")
    return join_by_size(prints, named, ["fp"], "n", prints.count()).select(id_col, "fp", "component_id")


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one."""
    tokens = [w for w in _SPACES.split((text or b"").translate(_ASCII_LOWER)) if w]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(tokens[i : i + words]), SEED) for i in range(max(1, len(tokens) - words + 1))], np.uint64))


def _bands(hashes: np.ndarray) -> list[int]:
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512] * _TURNS).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with __node (tells shingle sets apart), __fp (its fingerprint), __size, __bands
    and __set: the set as sorted distinct 32-bit parts of its hashes."""

    def run(texts: list[bytes | None]) -> dict[str, list]:
        out: dict[str, list] = {"__node": [], "__fp": [], "__size": [], "__bands": [], "__set": []}
        for t in texts:
            hashes = shingle_hashes(t, words)
            short = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
            out["__node"].append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63))
            out["__fp"].append(int(np.uint64(set_fingerprint(hashes)).view(np.int64)))
            out["__size"].append(len(short))
            out["__bands"].append(_bands(hashes))
            out["__set"].append(short.tobytes())
        return out

    fields = [("__node", T.LongType()), ("__fp", T.LongType()), ("__size", T.LongType()), ("__bands", T.ArrayType(T.LongType())), ("__set", T.BinaryType())]
    return with_arrow_columns(docs, text_col, T.StructType([T.StructField(*f) for f in fields]), run)


def _set_forest(sets: list[np.ndarray], likeness: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the pairs of sets with at least ``likeness``, with loops at roots, as ``_forest``."""
    left, right = [], []
    sizes = np.array([len(s) for s in sets])
    rest = np.arange(len(sets))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        left.append(queue[0])
        right.append(queue[0])
        while queue and len(rest):
            at = queue.pop()
            n = sizes[at]
            tried = rest[np.minimum(sizes[rest], n) >= likeness * np.maximum(sizes[rest], n) - 1e-9]
            if not len(tried):
                continue
            every = np.concatenate([sets[i] for i in tried])
            place = np.minimum(np.searchsorted(sets[at], every), n - 1)
            same = np.add.reduceat((sets[at][place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[tried])[:-1]]))
            hit = tried[same >= likeness * (n + sizes[tried] - same) - 1e-9]
            left += [at] * len(hit)
            right += hit.tolist()
            queue += hit.tolist()
            rest = np.setdiff1d(rest, hit, assume_unique=True)
    return left, right


def _like_links(likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            left, right = _set_forest(sets, likeness)
            a, b = np.array(nodes, np.int64)[left], np.array(nodes, np.int64)[right]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), at[0], np.int64)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])

        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("pair").to_pylist(), strict=True)
            for key, node, words in zip(keys, batch.column("node").to_pylist(), batch.column("set"), strict=True):
                if key != at:
                    if nodes:
                        yield links()
                    at, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(words.as_py(), np.uint32))
        if nodes:
            yield links()

    return run


def _met_by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(key, node, row, size): a bucket for each link of fingerprints that pigeonring filtering finds,
    and one for each fingerprint of several nodes."""
    prints = written(nodes.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    pairs = links(prints.select("fp", F.col("fp").alias("node"))).union(prints.where("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    asked = pairs.select(F.xxhash64(F.lit("fp"), "a", "b").alias("key"), F.explode(F.array_distinct(F.array("a", "b"))).alias("fp"))
    return asked.join(nodes, "fp").select("key", "node", "row", "size")


def _meeting(sets: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """``sets`` without most of those whose row is not in ``asked``: rows are marked in a table of
    ``bits`` bits, at most ``bits`` / 32 rows, which is broadcast. The join that follows is exact."""
    bit = F.pmod(F.xxhash64("row"), F.lit(bits))
    word = F.floor(bit / 32).alias("__word")
    mark = F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(32))), (bit % 32 + 1).cast("int"))
    marks = asked.select(word, mark.alias("__mark")).groupBy("__word").agg(F.bit_or("__mark").alias("__marks"))
    found = sets.withColumns({"__word": F.floor(bit / 32), "__mark": mark}).join(F.broadcast(marks), "__word")
    return found.where(F.col("__marks").bitwiseAND(F.col("__mark")) != 0).select(*sets.columns)


def like_links(rows: DataFrame, likeness: float = 0.8, block: int = SET_BLOCK, block_rows: int = SET_ROWS) -> DataFrame:
    """(a, b) with a < b: links that connect the same nodes as all pairs that meet by
    fingerprint or band and are at least ``likeness`` alike. ``rows``: __row and ``shingle_sets``."""
    ship(rows.sparkSession)
    nodes = rows.groupBy("__node").agg(F.min("__row").alias("row"), F.first("__fp").alias("fp"), F.first("__size").alias("size"), F.first("__bands").alias("bands"))
    nodes = written(nodes.select(F.col("__node").alias("node"), "row", "fp", "size", "bands"), "nodes")
    shared = nodes.select("node", F.explode("bands").alias("key")).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    shared = written(shared.select("key"), "shared-bands")
    keyed = nodes.select("node", "row", "size", F.explode("bands").alias("key"))
    banded = keyed.join(shared, "key").select("key", "node", "row", "size")
    members = written(banded.union(_met_by_fingerprint(nodes.drop("bands"))), "met-members")
    # Buckets of the same members are one: count and two digests tell members apart.
    found = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = found.groupBy("n", "total", "x", "y").agg(F.min("key").alias("key"))
    chosen = written(chosen.select("key", "n", F.ceil(F.greatest(F.col("total") / block, F.col("n") / block_rows)).cast("int").alias("blocks")), "buckets")
    members = written(join_by_size(members, chosen, ["key"], "n", members.count()).select("key", "node", "row", "size", "blocks"), "bucket-members")
    # The sets of all documents are as large as the texts: they are never broadcast.
    sets = rows.select(F.col("__row").alias("row"), F.col("__set").alias("set"))

    def compare(asked: DataFrame) -> DataFrame:
        dealt = asked.join(_meeting(sets, asked, MEETING_BITS).hint("merge"), "row").select("key", "pair", "node", "set")
        return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_like_links(likeness), "key long, a long, b long")

    return _meet(members, compare, block)


def keep_unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, likeness: float = 0.8) -> DataFrame:
    """One row of ``docs``, all columns, of each group linked by shingles at least ``likeness`` alike."""
    rows = written(shingle_sets(docs, text_col, words).withColumn("__row", F.monotonically_increasing_id()), "shingles")
    return _first_rows(rows, components(like_links(rows, likeness), "like-links"), id_col, docs.columns)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, tau: int = 4, segments: int = SEGMENTS) -> DataFrame:
    """One row of ``docs``, all columns, of each group linked by fingerprints."""
    rows = fingerprints(docs, id_col, text_col, words, docs.columns, "__node").withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows, "fingerprints")
    nodes = rows.select(F.col("__node").alias("fp")).distinct().withColumn("node", F.col("fp"))
    return _first_rows(rows, components(links(nodes, tau, segments), "simhash-links"), id_col, docs.columns)


def _first_rows(rows: DataFrame, comps: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Of ``rows`` (with __row and __node) the first of each component of nodes, by id, nulls last, then __row."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("__row").alias("row"))
    bare = rows.select("__node", F.col(id_col).alias("id"), "__row")
    # Copies are one row a node before anything meets by component.
    nodes = written(bare.groupBy("__node").agg(F.min(order).alias("first"), F.count("*").alias("n")), "first-rows")
    linked = written(nodes.join(comps, F.col("__node") == F.col("node")).select("__node", "first", "n", "component"), "linked")
    best = written(linked.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("members")), "best")
    stays = join_by_size(linked.select("__node", "n", "component"), best, ["component"], "members", linked.count())
    alone = nodes.join(linked, "__node", "left_anti").where("n > 1").select("__node", "n", F.col("first").alias("best"))
    stays = written(stays.select("__node", "n", "best").unionByName(alone), "stays")
    gone = join_by_size(bare.select("__node", "__row"), stays, ["__node"], "n", rows.count()).where(F.col("__row") != F.col("best.row"))
    return rows.join(written(gone.select("__row"), "copies"), "__row", "left_anti").select(*columns)
