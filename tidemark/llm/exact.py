"""Exact dedup by an extendible-hash index on shared files.

Every text has a 64-bit key. The directory maps prefixes of the key to buckets.
It starts at depth 0 and doubles while a bucket is overfull: that bucket is split
on its next bit, all others keep their depth. What counts is the number of
*distinct* keys in a prefix (estimated by sketches that are combined before the
shuffle), so a group of copies does not split a bucket in vain. Buckets hold
``bucket_entries`` keys, or the 1/MOST_BUCKETS part of all if that is more, so the
directory has a few thousand rows at every size and is broadcast.

1. One pass over the texts writes (row, id, key, digest) to the shared folder.
2. Texts are routed to their bucket through the directory. Copies are combined
   before the shuffle and compared byte for byte, within (bucket, key): an entry is
   a distinct text. The owner task of a bucket chains the entries of one key, and
   the index (bucket, key, chain, digest) is written, split by bucket.
3. The rows of each entry are counted and the one that stays is chosen in the
   entry's bucket; every row then looks its entry up by bucket, key and digest. Entries
   of very many rows are looked up by broadcast: there are few of them.

Main path: DataFrame functions only.

Defined results: null counts as the empty text; the row with the largest id stays, a
null id is smaller than every id; of rows with one text and one id (or without
any), the first read stays, so every group keeps exactly one row; a group
without ids has keep_id null; an empty table gives an empty result; very long texts are
compared whole, one a row in memory; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_size, new_path, written

BUCKET_ENTRIES = 1 << 16
MOST_BUCKETS = 1 << 12
FULL_DEPTH = 24


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, int]:
    """((cell, depth, bucket), cell_depth): for each prefix of ``cell_depth`` bits in use the
    depth of its bucket and the bucket, named by that depth and its prefix.

    The directory doubles until no cell is overfull; a bucket's depth is the least at
    which its cells together fit. At FULL_DEPTH bits it stops: there a cell is
    overfull only if the hash itself fails, and is still worked right."""
    total = keys.select(F.approx_count_distinct("key")).first()[0]
    room = max(bucket_entries, -(-total // MOST_BUCKETS))
    depth = max(0, math.ceil(math.log2(max(total, 1) / room)))
    while True:
        cells = written(keys.groupBy(_prefix(F.col("key"), depth).alias("cell")).agg(F.approx_count_distinct("key").alias("n")), "directory")
        if depth >= FULL_DEPTH or cells.where(F.col("n") > room).isEmpty():
            break
        depth += 1
    own = F.lit(depth)
    for d in reversed(range(depth)):
        held = F.sum("n").over(Window.partitionBy(F.shiftright("cell", depth - d)))
        cells = cells.withColumn(f"at_{d}", held)
        own = F.when(F.col(f"at_{d}") <= room, F.lit(d)).otherwise(own)
    cells = cells.select("cell", own.alias("depth"))
    bucket = F.concat_ws(":", F.col("depth").cast("string"), F.expr(f"shiftright(cell, {depth} - depth)").cast("string"))
    return written(cells.withColumn("bucket", bucket), "buckets"), depth


def _routed(df: DataFrame, cells: DataFrame, cell_depth: int) -> DataFrame:
    """``df`` (with key) with the bucket that the directory names for the key."""
    return df.withColumn("cell", _prefix(F.col("key"), cell_depth)).join(F.broadcast(cells), "cell").drop("cell")


def build_index(docs: DataFrame, cells: DataFrame, cell_depth: int, text_col: str = "text") -> DataFrame:
    """(bucket, depth, key, chain, digest) of the distinct texts, a table in the shared folder."""
    text = F.coalesce(text_col, F.lit(""))
    rows = _routed(docs.select(text.alias("text")).withColumn("key", F.xxhash64("text")), cells, cell_depth)
    # The text itself is a grouping key: within a bucket's key, equality is decided on all bytes.
    entries = rows.groupBy("bucket", "depth", "key", "text").agg(F.lit(1).alias("one"))
    entries = entries.select("bucket", "depth", "key", F.sha2("text", 256).alias("digest"))
    owned = entries.repartition("bucket")
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest")).cast("long"))
    path = new_path(docs.sparkSession, "buckets")
    chained.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(chained.schema).parquet(path)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, bucket, depth, chain."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("digest"))
    rows = written(rows, "keys")
    cells, cell_depth = directory(rows, bucket_entries)
    index = build_index(docs, cells, cell_depth, text_col)
    routed = _routed(rows, cells, cell_depth).drop("depth")
    place = ["bucket", "key", "digest"]
    largest = F.max(F.struct(F.col("id").isNotNull().alias("some"), F.col("id"), (-F.col("row")).alias("first"))).alias("best")
    groups = routed.groupBy(*place).agg(largest, F.count("*").alias("group_size"))
    entries = written(index.join(groups, place), "entries")
    found = join_by_size(routed, entries, place, "group_size", rows.count())
    return found.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (-F.col("row") == F.col("best.first")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "depth",
        "bucket",
        "chain",
    )
