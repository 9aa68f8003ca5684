"""Numbers along an order, without a group in one task.

Rows are dealt into ranges of the order (sampled by Spark, sized by its shuffle settings)
and written with the number of their range; counts of ranges, one row for each key that
a range holds, shift the numbers that rows get within their range. A key of any
size is as many tasks as it fills ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def placed(df: DataFrame, keys: list[str], order: list[str], place: str = "pos", size: str | None = None) -> DataFrame:
    """``df`` with each row's place (from 0) in ``order`` among the rows of its key, or of the table without
    keys, and in ``size``, if it is given, the number of those rows.

    Rows equal in keys and order are numbered in any order; null keys are a key, and nulls
    come first in an order."""
    dealt = written(df.repartitionByRange(*(F.col(c) for c in [*keys, *order])).withColumn("__range", F.spark_partition_id()), "ranges")
    marks = [f"__k{i}" for i in range(len(keys))]
    # Keys meet as texts that are never null: a join by equality loses no null key.
    named = dealt.withColumns({m: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for m, k in zip(marks, keys, strict=True)}) if keys else dealt
    counts = named.groupBy("__range", *marks).agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*marks)
    upto = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifts = counts.select("__range", *marks, (F.sum("__c").over(upto) - F.col("__c")).alias("__before"), F.sum("__c").over(whole).alias("__all"))
    within = F.row_number().over(Window.partitionBy("__range", *marks).orderBy(*order)) - 1
    out = named.withColumn("__within", within).join(shifts, ["__range", *marks])
    added = {place: (F.col("__before") + F.col("__within")).cast("long")} | ({size: F.col("__all")} if size else {})
    return out.withColumns(added).select(*(c for c in df.columns if c not in added), *added)
