"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions, racks and shards. A document descends
from the root: on each level every child draws ``-ln(u) / weight`` from a hash
of the document id and the child's name, and the smallest draw wins. A child's
draw depends on nothing but its own name and weight, so a change of weights
moves documents only between the subtree that changed and its siblings, and a
shard that opens a rack and region of its own takes documents only into itself.

Shard s stands in rack ``s // SHARDS_A_RACK``; rack r in region
``r // RACKS_A_REGION``. A full tree of 40 shards has 2 regions of 5 racks of 4
shards; shard 40 opens region 2. (A shard that joins a region with room raises
that region's weight; documents that move then stay within that region.)

A document's place depends on its id and the shard count alone: no shuffle and
no state. Only the slots (0, 1, ... within a shard) need a count: rows are
numbered within small hashed cells of a shard and shifted by the cells' running
totals, so no task orders a whole shard, and a cell that repeated rows overfill is
numbered in pieces.

Main path: DataFrame functions only.

Defined results: a null text has size ``OVERHEAD`` and the CRC of no bytes; a null
id is placed like any id; repeated ids land in one shard in slots of their own; an empty
table gives an empty result; of very long texts only the size and the CRC are kept;
extra columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hot_limit, written

SHARDS_A_RACK = 4
RACKS_A_REGION = 5
OVERHEAD = 16
CELL_ROWS = 1 << 12
_UNIT = float(1 << 53)


def tree(weights: list[float]) -> dict[int, dict[int, dict[int, float]]]:
    """{region: {rack: {shard: weight}}} of shards 0 to len(weights) - 1."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for s, w in enumerate(weights):
        if w < 0 or not math.isfinite(w):
            raise ValueError("weights must be finite and not negative")
        rack = s // SHARDS_A_RACK
        out.setdefault(rack // RACKS_A_REGION, {}).setdefault(rack, {})[s] = w
    return out


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _draw(id_: Column, level: str, child: Column) -> Column:
    """Exponential variate of rate ``weight``, from the hash of (id, level, child)."""
    u = (F.shiftrightunsigned(F.xxhash64(id_, F.lit(level), child["name"]), 11).cast("double") + F.lit(0.5)) / F.lit(_UNIT)
    return -F.log(u) / child["weight"]


def _choose(id_: Column, level: str, children: Column) -> Column:
    """Child with the smallest draw; ties go to the smaller child."""
    draws = F.transform(children, lambda c: F.struct(_draw(id_, level, c).alias("draw"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def _children(node: dict) -> Column:
    alive = [(c, _weight(n)) for c, n in sorted(node.items()) if _weight(n) > 0]
    return F.array(*(F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in alive))


def place(df: DataFrame, id_col: str, name: str, shards: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """Add the int column ``name``: the shard of each row. One column a level, so
    that a level's draws are made once."""
    weights = [1.0] * shards if weights is None else weights
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    level, nodes = F.lit(0), {0: tree(weights)}
    for kind in ("region", "rack", "shard"):
        children, below = None, {}
        for at, node in sorted(nodes.items()):
            if _weight(node) > 0:
                children = F.when(level == at, _children(node)) if children is None else children.when(level == at, _children(node))
                below |= node
        temp = name if kind == "shard" else f"__{name}_{kind}"
        df = df.withColumn(temp, _choose(F.col(id_col), kind, children))
        level, nodes = F.col(temp), below
    return df.drop(f"__{name}_region", f"__{name}_rack")


def with_slots(df: DataFrame, shard_col: str, order: list[Column], name: str = "slot", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Cells are hashed pieces of a shard of about ``cell_rows`` rows; the cells'
    counts (one row each) give the offset of each cell. Only rows equal in ``order``
    can overfill a cell: its rows are written with running numbers, which deal them
    into pieces."""
    cells = 1 + F.floor(F.col("__n") / F.lit(cell_rows))
    sizes = written(df.groupBy(shard_col).agg(F.count("*").alias("__n")), "shards")
    # One row a shard: the number of shards is a parameter, so this is bounded.
    dealt = df.join(F.broadcast(sizes), shard_col).withColumn("__cell", F.pmod(F.xxhash64(*order), cells)).drop("__n")
    counts = written(dealt.groupBy(shard_col, "__cell").agg(F.count("*").alias("__c")), "cells")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    over = counts.where(F.col("__c") > hot_limit(total, 4 * cell_rows)).select(shard_col, "__cell", F.ceil(F.col("__c") / cell_rows).alias("__pieces"))
    parts = [dealt.withColumn("__piece", F.lit(0).cast("long"))]
    if not over.isEmpty():
        hot = F.broadcast(over)  # at most HOT_KEYS cells
        crowded = dealt.join(hot, [shard_col, "__cell"]).withColumn("__piece", F.monotonically_increasing_id())
        crowded = written(crowded, "crowded").withColumn("__piece", F.pmod("__piece", "__pieces")).drop("__pieces")
        parts = [parts[0].join(hot, [shard_col, "__cell"], "left_anti"), crowded]
        pieces = crowded.groupBy(shard_col, "__cell", "__piece").agg(F.count("*").alias("__c"))
        counts = counts.join(hot, [shard_col, "__cell"], "left_anti").withColumn("__piece", F.lit(0).cast("long")).unionByName(pieces)
    else:
        counts = counts.withColumn("__piece", F.lit(0).cast("long"))
    at = [shard_col, "__cell", "__piece"]
    before = Window.partitionBy(shard_col).orderBy("__cell", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*at, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1
    numbered = reduce(DataFrame.unionByName, parts).withColumn("__within", within).join(offsets, at)
    return numbered.withColumn(name, (F.col("__offset") + F.col("__within")).cast("long")).drop(*at[1:], "__within", "__offset")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, text_crc32, law, shard, slot, grown_shard."""
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    raw = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    placed = docs.select(
        *keep,
        (F.length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(id_col).alias("__id"),
    )
    placed = place(place(placed, "__id", "shard", shards), "__id", "grown_shard", shards + 1)
    order = [F.col("__id"), F.col("text_crc32"), F.col("size")]
    return with_slots(placed, "shard", order).select(*keep, *added)
