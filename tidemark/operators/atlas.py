"""Tiling of ordered segments into overlapping sections, and chains of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import rounded
from tidemark.operators import graph, ranking
from tidemark.operators import ordered as numbers
from tidemark.sources.scratch import written

SIZE, STRIDE = 6, 5


def tiled(ordered: DataFrame, chain: str, order: list[str], size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """Rows with their section number ``g``: groups of ``size`` every ``stride`` rows along a
    chain, groups of one dropped. A row in an overlap appears once for each section."""
    rows = numbers.placed(ordered, [chain], order, "pos", "n")
    first = F.greatest(F.ceil((F.col("pos") - (size - 1)) / stride), F.lit(0))
    last = F.floor(F.col("pos") / stride)
    out = rows.withColumn("g", F.explode(F.sequence(first, last)))
    return out.where(F.col("n") - F.col("g") * stride >= 2).drop("n")


def sections(rows: DataFrame, chain: str, pad: float = 0.005, frac: str | None = None, chain_degrees: str | None = None) -> DataFrame:
    """One row for each section. Its length follows from the fractions of the chain it
    spans, if they are known, and is 250 m a segment at least."""
    span = (F.max(frac) - F.min(frac)) * F.max(chain_degrees) * 111_000 if frac and chain_degrees else F.lit(0.0)
    return rows.groupBy(chain, "g").agg(
        F.count("*").alias("segment_count"),
        F.round(F.avg("lat"), 6).alias("centroid_lat"),
        F.round(F.avg("lon"), 6).alias("centroid_lon"),
        F.round(F.min("lon") - pad, 6).alias("west"),
        F.round(F.min("lat") - pad, 6).alias("south"),
        F.round(F.max("lon") + pad, 6).alias("east"),
        F.round(F.max("lat") + pad, 6).alias("north"),
        rounded(F.avg("total_score"), 1).alias("mean_score"),
        F.max("total_score").alias("max_score"),
        F.round(F.greatest(span, F.count("*") * 250.0), 0).alias("coastline_length_m"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "segment_id"))), lambda s: s["segment_id"].cast("string")), ",").alias("segment_ids"),
    )


def numbered(df: DataFrame, order: list[str], name: str = "section_id", template: str = "atlas-%04d") -> DataFrame:
    """Consecutive ids in order."""
    return numbers.placed(df, [], order, "__n").withColumn(name, F.format_string(template, F.col("__n") + 1)).drop("__n")


def chains(edge_list: DataFrame) -> DataFrame:
    """(edge, chain): edges that meet in a point of exactly two edges form one chain,
    named by its smallest edge.

    Of rows with one edge id, the one with the smallest ends counts; rows without an
    id are ignored, and points that are null meet nothing."""
    once = edge_list.where("edge is not null").groupBy("edge").agg(F.min(F.struct("u", "v")).alias("e")).select("edge", "e.u", "e.v")
    once = written(once, "edges")
    ends = once.select("edge", F.explode(F.array("u", "v")).alias("point")).where("point is not null")
    passing = ends.groupBy("point").agg(F.count("*").alias("n"), F.min("edge").alias("a"), F.max("edge").alias("b")).where("n = 2 and a <> b")
    found = graph.components(passing.select("a", "b"), "chains")
    return once.join(found, F.col("edge") == F.col("node"), "left").select("edge", F.coalesce("component", "edge").alias("chain"))


def measured(edge_list: DataFrame, least: float = 0.0) -> DataFrame:
    """(chain, n_edges, length, place): chains of ``edge_list`` (edge, u, v, length) longer
    than ``least``, and their place by falling length, the smaller chain first on ties."""
    lengths = edge_list.where("edge is not null").groupBy("edge").agg(F.min(F.struct("u", "v", "length")).alias("e")).select("edge", "e.length")
    whole = chains(edge_list).join(lengths, "edge").groupBy("chain").agg(F.count("*").alias("n_edges"), F.sum("length").alias("length"))
    whole = written(whole.where(F.col("length") > least), "chain-lengths")
    high = whole.agg(F.max("length")).first()[0] or 1.0
    ranked = ranking.ranked(whole, "length", ["chain"], least, max(high, least + 1e-9))
    return ranked.select("chain", "n_edges", "length", F.col("rank").alias("place"))
