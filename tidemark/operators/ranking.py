"""Evidence components, composite scores, ranks and percentiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions.rounding import mean_rounded, rounded
from tidemark.sources.scratch import written

FLAT_SWELL, FLAT_FOAM, PENALTY = 0.5, 0.2, 5.0


def usable() -> Column:
    """Detections that count as evidence."""
    return (F.coalesce("quality_score", F.lit(0.0)) >= 60) & F.col("foam_fraction").isNotNull()


def evidence_aggregates() -> list[Column]:
    """Aggregates of the foam evidence, to be used alone or beside others."""
    foam, swell = F.col("foam_fraction"), F.coalesce("swell_height_m", F.lit(0.0))
    ok = usable()
    n = F.count(F.when(ok, 1))
    return [
        n.alias("n_valid"),
        F.max(F.when(ok, foam)).alias("max_foam"),
        F.coalesce(F.avg(F.when(ok & (swell >= 1.0), foam)), F.lit(0.0)).alias("mean_swell_foam"),
        (F.count(F.when(ok & (foam > 0.05), 1)) / F.when(n > 0, n)).alias("consistency"),
        (F.max(F.when(ok, foam)) - F.min(F.when(ok, foam))).alias("foam_range"),
        F.max(F.when(ok & (F.col("swell_height_m") < FLAT_SWELL) & (foam > FLAT_FOAM), 1).otherwise(0)).alias("flat_day_foam"),
    ]


def with_foam_component(agg: DataFrame) -> DataFrame:
    """Add the foam component (null without evidence) and the penalty."""
    score = scores.foam_score(F.col("max_foam"), F.col("mean_swell_foam"), F.col("consistency"), F.col("foam_range"))
    return agg.withColumns({"foam_component": F.when(F.col("n_valid") > 0, rounded(score, 2)), "penalty": F.col("flat_day_foam") * PENALTY})


def foam_evidence(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Foam component and its parts: one aggregate."""
    return with_foam_component(detections.groupBy(*keys).agg(*evidence_aggregates()))


def cells(df: DataFrame, score: Column, low: float, high: float, n: int = 1024) -> DataFrame:
    """Add ``__cell``: the equal-width cell of the score, 0 for the highest."""
    at = F.floor((F.lit(high) - score) / (high - low) * n)
    return df.withColumn("__cell", F.greatest(F.lit(0), F.least(at, F.lit(n - 1))).cast("int"))


def ranked(df: DataFrame, score: str, ties: list[str], low: float = 0.0, high: float = 100.0, n: int = 1024) -> DataFrame:
    """Rank, competition rank, share of rows at or below, and count of all.

    A global window would order everything in one task. Rows are dealt into
    ``n`` cells of the score instead; cell counts (``n`` rows, broadcast) shift
    the ranks within each cell."""
    dealt = cells(df, F.col(score), low, high, n)
    counts = dealt.groupBy("__cell").agg(F.count("*").alias("__c"))
    every = Window.partitionBy().orderBy("__cell")
    before = counts.select("__cell", (F.sum("__c").over(every) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("n_total"))
    within = Window.partitionBy("__cell").orderBy(F.desc(score), *ties)
    tied = Window.partitionBy("__cell").orderBy(F.desc(score))
    return (
        dealt.withColumns({"__row": F.row_number().over(within), "__rank": F.rank().over(tied)})
        .join(F.broadcast(before), "__cell")
        .withColumns({"rank": (F.col("__before") + F.col("__row")).cast("long"), "competition_rank": (F.col("__before") + F.col("__rank")).cast("long")})
        .drop("__cell", "__row", "__rank", "__before")
    )


def percentile_of_rank(rank: Column, n: Column) -> Column:
    return F.round((1 - rank / n) * 100, 1)


def distribution(df: DataFrame, score: str, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), places: int | None = None) -> DataFrame:
    """Exact, interpolated percentiles and moments of a score; one row. The mean of scores
    of at most ``places`` decimal places is exact.

    Rows are ranked in cells and not held together: only the two rows on either side of
    each percentile are read. Null scores do not count; without any, all but n is null."""
    known = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"))
    moments = known.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), (F.round(F.avg("s"), 4) if places is None else mean_rounded("s", places, 4)).alias("mean"))
    n, low, high, mean = moments.first()
    wanted = {k: (math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1) % 1) for k, p in enumerate(points)} if n else {}
    rows = ranked(known, "s", [], low, max(high, low + 1e-9)) if n else known.withColumns({"rank": F.lit(None).cast("long")})
    # Ranks fall with the score: place 0 is the lowest score, of rank n.
    at = rows.where(F.col("rank").isin(sorted({n - i for a, b, _ in wanted.values() for i in (a, b)})))
    value = lambda place: F.max(F.when(F.col("rank") == n - place, F.col("s")))
    cut = [(value(wanted[k][0]) * (1 - wanted[k][2]) + value(wanted[k][1]) * wanted[k][2] if n else F.lit(None).cast("double")) for k in range(len(points))]
    names = [f"p{round(p * 100)}" for p in points]
    found = at.agg(*(F.round(c, 4).alias(name) for c, name in zip(cut, names, strict=True)))
    known_ones = [F.round(F.lit(v).cast("double"), 4).alias(f"{name}_score") for name, v in (("min", low), ("max", high), ("mean", mean))]
    return found.select(F.lit(n).cast("long").alias("n"), *known_ones, *names)


def upper_median(df: DataFrame, keys: list[str], value: str, name: str, buckets: int = 1024, most: int = 65_536) -> DataFrame:
    """Element n div 2 of the sorted values of each key."""
    return at_place(df, keys, value, lambda n: F.floor(n / 2), name, buckets, most)


def at_place(df: DataFrame, keys: list[str], value: str, place, name: str, buckets: int = 1024, most: int = 65_536) -> DataFrame:
    """(keys, name): the value at ``place`` (of the number of values, from 0) in each key's order.

    Equal values are counted as one row. While a key has more than ``most`` different values
    in question, a histogram of ``buckets`` ranges between its least and its greatest one tells which
    range holds the place, and only that one stays; each round is one aggregate
    combined before the shuffle. No task orders more than ``most`` rows of a key."""
    open_ = written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n")), "values")
    total = open_.groupBy(*keys).agg(F.sum("n").alias("__all"))
    asked = written(total.select(*keys, place(F.col("__all")).alias("__place"), F.lit(0).cast("long").alias("__before")), "places")
    while (open_.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > most:
        ends = open_.groupBy(*keys).agg(F.min("v").alias("__low"), F.max("v").alias("__high"))
        share = (F.col("v").cast("double") - F.col("__low")) / F.nullif(F.col("__high").cast("double") - F.col("__low"), F.lit(0.0))
        at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1))
        bounds = ends.join(asked, keys)
        counts = open_.join(ends, keys).groupBy(*keys, at.alias("__at")).agg(F.sum("n").alias("__c"), F.min("v").alias("__from"), F.max("v").alias("__to"))
        upto = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = counts.withColumn("__upto", F.sum("__c").over(upto)).join(bounds, keys).withColumn("__less", F.col("__before") + F.col("__upto") - F.col("__c"))
        held = written(known.where((F.col("__less") <= F.col("__place")) & (F.col("__place") < F.col("__less") + F.col("__c"))).select(*keys, "__place", F.col("__less").alias("__before"), "__from", "__to"), "ranges")
        asked = held.select(*keys, "__place", "__before")
        open_ = written(open_.join(held.select(*keys, "__from", "__to"), keys).where(F.col("v").between(F.col("__from"), F.col("__to"))).select(*keys, "v", "n"), "values")
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = open_.withColumn("__upto", F.sum("n").over(upto)).join(asked, keys).withColumn("__upto", F.col("__before") + F.col("__upto"))
    return placed.where((F.col("__upto") - F.col("n") <= F.col("__place")) & (F.col("__place") < F.col("__upto"))).select(*keys, F.col("v").alias(name))
