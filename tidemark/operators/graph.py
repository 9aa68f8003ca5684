"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long): the smallest node reachable.

    In each round every node is represented by the first of its neighbours and
    itself: in the order of the nodes in two rounds of three (stars collapse in two), in
    a new random order in the third (so that paths shrink by a constant factor,
    whatever their numbering). Edges between representatives remain, each once; the
    graph shrinks until none is left, and the rounds' representatives are joined
    from the last to the first. A round is one aggregate and two joins whose skew
    Spark can split; no group is gathered. Loops (a = a) are nodes of their own;
    edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    loops = edges.where("a = b").select("a")
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = F.xxhash64 if len(rounds) % 3 == 2 else lambda node, _: node
        placed = lambda c: F.struct(order(F.col(c), F.lit(len(rounds))).alias("at"), F.col(c).alias("b"))
        first = both.groupBy("a").agg(F.min(placed("b")).alias("m"))
        rep = F.least(F.col("m"), placed("a"))["b"]
        rounds.append(written(first.select(F.col("a").alias("node"), rep.alias("rep")), f"{name}-{len(rounds)}"))
        of = rounds[-1]
        left = edges.join(of, F.col("a") == F.col("node")).select(F.col("rep").alias("a"), "b")
        moved = left.join(of, F.col("b") == F.col("node")).select("a", F.col("rep").alias("b")).where("a <> b")
        edges = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    if not rounds:
        return loops.distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    last = rounds[-1]
    for of in reversed(rounds[:-1]):
        onward = last.select(F.col("node").alias("via"), F.col("rep").alias("end"))
        last = of.join(onward, F.col("rep") == F.col("via"), "left").select("node", F.coalesce("end", "rep").alias("rep"))
    last = written(last, name)
    named = written(last.groupBy("rep").agg(F.min("node").alias("component")), name)
    found = last.join(named, "rep").select("node", "component")
    alone = loops.distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.union(alone.join(found.select("node"), "node", "left_anti"))
