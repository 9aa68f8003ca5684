"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share, by weight, of ``share`` times all sizes; a
target above ``limit`` times its source's size is cut there and the excess is
shared out again by weight until none is above. A document of a source is to be
taken target / source_size times. The whole part of that is taken surely; the
fractional parts are rounded by pivots: two documents exchange mass, weighted
by their sizes, at random until one of them is taken or dropped, so that the
words to be taken stay what they were and every document keeps its expected
number of copies.

Pivots run in a reduction tree. On each level the open documents of a source
are dealt into small hashed groups of about ``FAN_IN``; a group is folded by
pivots, larger documents first, and passes on the one document that is still
open. The number of levels is the logarithm of the largest source; no task
sees more than a group, however large a source is. What remains at a source's
root is rounded to the nearer side: the taken words miss the target by at most
half of that one document.

The sources themselves (one row each) are ordered in one small window to find
the cut targets.

Main path: DataFrame functions only.

Defined results: a null text has size 0 and takes 0; the null source is a source,
last in order; all sizes 0 gives targets 0; draws are hashes of id, text and
level, so reruns agree; repeated rows are documents of their own, and those equal in
source, id and text are rounded by their number, so they never gather; an empty table
gives an empty result; very long texts are counted whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_size, numbered, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
FAN_IN = 48
SEED = 20
EPS = 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sizes`` (source, source_size) with target, one row for each source."""
    every = Window.partitionBy()
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    # Sources are cut in the order of limit * size / weight: those before a source are cut if it is.
    by_ratio = every.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(every), F.sum("w").over(every)
    left = share * total - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rate = left / (heavy - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("rate", rate).withColumn("cut", F.col("source_size") * limit <= F.col("rate") * F.col("w"))
    common = F.min(F.when(~F.col("cut"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "rate"))).over(every)["rate"]
    target = F.when(F.col("cut"), F.col("source_size") * limit).otherwise(common * F.col("w"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(*of: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") + 0.5) / float(1 << 53)


_DONE = "array<struct<uid:long,taken:int>>"
_ROW = ("size", "seed", "uid", "p")


def _row(size: Column, seed: Column, uid: Column, p: Column) -> Column:
    return F.struct(size.alias("size"), seed.alias("seed"), uid.alias("uid"), p.alias("p"))


def _fold(group: Column, level: int) -> Column:
    """The group's open document (p = 0 or 1: none is open) and ``done``, those decided."""

    def step(state: Column, x: Column) -> Column:
        a, b = state["size"].cast("double"), x["size"].cast("double")
        p, q = state["p"], x["p"]
        # Mass p*a + q*b is kept. Raising p by up / a lowers q by up / b, and the other way round.
        up = F.least((1 - p) * a, q * b)
        down = F.least(p * a, (1 - q) * b)
        rise = _uniform(state["seed"], x["seed"], F.lit(level), F.lit(SEED)) * (up + down) < down
        p2 = F.when(rise, p + up / a).otherwise(p - down / a)
        q2 = F.when(rise, q - up / b).otherwise(q + down / b)
        first_done = (p2 < EPS) | (p2 > 1 - EPS)
        opened = F.when(first_done, _row(x["size"], x["seed"], x["uid"], q2)).otherwise(_row(state["size"], state["seed"], state["uid"], p2))
        closed = F.when(first_done, F.struct(state["uid"].alias("uid"), F.round(p2).cast("int").alias("taken"))).otherwise(F.struct(x["uid"].alias("uid"), F.round(q2).cast("int").alias("taken")))
        return F.struct(*(opened[c].alias(c) for c in _ROW), F.concat(state["done"], F.array(closed)).alias("done"))

    first = F.element_at(group, 1)
    start = F.struct(*(first[c].alias(c) for c in _ROW), F.array().cast(_DONE).alias("done"))
    return F.aggregate(F.slice(group, 2, F.greatest(F.size(group) - 1, F.lit(0))), start, step)


def pivotal_rounding(open_: DataFrame, largest: int, fan_in: int = FAN_IN) -> DataFrame:
    """(uid, taken) of rows (source, size, seed, uid, p) with 0 < p < 1 and size > 0.

    ``largest`` bounds the rows of one source and sets the number of levels."""
    decided = None
    level = 0
    while True:
        groups = max(1, -(-largest // fan_in))
        cell = F.pmod(F.xxhash64("seed", F.lit(level), F.lit(SEED)), F.lit(groups))
        folded = (
            open_.groupBy("source", cell.alias("cell"))
            .agg(F.sort_array(F.collect_list(F.struct(*_ROW)), asc=False).alias("g"))
            .select("source", _fold(F.col("g"), level).alias("s"))
        )
        folded = written(folded, f"pivots-{level}")
        done = folded.select(F.inline("s.done"))
        decided = done if decided is None else decided.union(done)
        rest = folded.select("source", *(f"s.{c}" for c in _ROW))
        if groups == 1:
            return decided.union(rest.select("uid", F.round("p").cast("int").alias("taken")))
        closed = (F.col("p") < EPS) | (F.col("p") > 1 - EPS)
        decided = decided.union(rest.where(closed).select("uid", F.round("p").cast("int").alias("taken")))
        open_ = rest.where(~closed)
        largest, level = groups, level + 1


def _decided(open_: DataFrame, largest: int, total: int) -> DataFrame:
    """(uid, taken) of the rows (source, size, seed, uid, p) with 0 < p < 1 and size > 0.

    Rows of one source, size and seed are the same text under the same id. Pivots
    among k of them take k * p rounded down and leave one open: that is done by
    counting, and only the one that is left enters the tree."""
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("source_key")
    key = ["source_key", "size", "seed"]
    alike = open_.groupBy("source", name, "size", "seed").agg(F.min("p").alias("p"), F.min("uid").alias("uid"), F.count("*").alias("k"))
    sure = F.floor(F.col("k") * F.col("p") + EPS)
    alike = written(alike.withColumn("sure", sure).withColumn("p", F.col("k") * F.col("p") - F.col("sure")), "alike")
    rounded = pivotal_rounding(alike.where(F.col("p") > EPS).select("source", *_ROW), largest)
    several = alike.where("k > 1")
    if several.isEmpty():
        return rounded
    met = written(several.join(rounded, "uid", "left").select(*key, "k", (F.col("sure") + F.coalesce("taken", F.lit(0))).alias("m")), "alike-taken")
    members = join_by_size(open_.select(name, "size", "seed", "uid"), met, key, "k", total)
    placed = numbered(written(members, "members"), key, "uid", "k", "at")
    single = rounded.join(several.select("uid"), "uid", "left_anti").select("uid", "taken")
    return single.unionByName(placed.select("uid", (F.col("at") < F.col("m")).cast("int").alias("taken")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken, and
    with ``keep`` the struct ``row`` of those columns of ``docs``."""
    carried = [F.struct(*keep).alias("row")] if keep else []
    sized = docs.select(F.col(id_col), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("seed"), *carried)
    # Rows are told apart by a running number, since ids may repeat; draws follow id and text.
    sized = written(sized.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = written(sources, "sources")
    aimed = targets(sources.select("source", "source_size"), weights, share, limit)
    aimed = written(aimed, "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(limit))).otherwise(0.0)
    near = F.abs(rate - F.round(rate)) < EPS
    parted = sized.join(aimed.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parted = parted.withColumn("whole", F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("int"))
    parted = parted.withColumn("p", F.when(near, 0.0).otherwise(rate - F.floor(rate)))
    totals = sources.agg(F.max("n"), F.sum("n")).first()
    open_ = parted.where("p > 0 and size > 0").select("source", *_ROW)
    rounded = _decided(open_, totals[0] or 0, totals[1] or 0)
    copies = F.col("whole") + F.coalesce("taken", F.lit(0))
    out = parted.join(rounded, "uid", "left")
    return out.select(id_col, "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "source", *(["row"] if keep else []))
