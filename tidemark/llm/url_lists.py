"""URL filters by a temporal list join.

List entries are dated: an entry adds a key to a list or removes it from there.
Per list and key, runs of equal actions become validity intervals
[valid_from, valid_to). A capture is judged by the entries that were active
when it was fetched: an as-of join on each of the keys that its URL falls
under (its host, each parent domain, host and first path segment).

Intervals are cut into periods of ``PERIOD_DAYS`` and joined on (key, period), so
that a key with a long history, or a host with a third of all captures, is
spread over its periods; within one (key, period) it is a plain equi-join, which
Spark splits if it is skewed. Few intervals are broadcast by Spark itself, after
measuring them.

Defined results: a null or unparsable URL falls under no key and is allowed; so is
a null fetch time; of entries with equal list, key and time, 'remove' wins;
entries with a null list, key, time or another action are ignored; repeated
captures are rows of their own; empty tables work; a very long URL is read whole, and has a
key for each label of its host, so that it costs the square of the host's length at most;
input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

PERIOD_DAYS = 30
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"
RESULT = ("host", "blocked", "n_entries", "lists", "matched_keys")


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def keys(url: Column) -> Column:
    """The host, its parent domains of two labels or more, and host/first segment."""
    name = host(url)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    segment = F.regexp_extract(url, _SEGMENT, 1)
    page = F.when(segment != "", F.array(F.concat(name, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(parents, page)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from (list, key, action, at); valid_to null: still valid."""
    usable = entries.where("list is not null and key is not null and at is not null and action in ('add', 'remove')")
    once = usable.groupBy("list", "key", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    order = Window.partitionBy("list", "key").orderBy("at")
    turns = once.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    ended = turns.withColumn("valid_to", F.lead("at").over(order))
    return ended.where("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def _period(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / F.lit(PERIOD_DAYS * 86_400)).cast("long")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with host, blocked, n_entries, lists and matched_keys (sorted, comma-joined)."""
    kept = [c for c in captures.columns if c not in RESULT]
    spans = intervals(entries)
    last = F.lit(captures.agg(F.max(time_col)).first()[0]).cast("timestamp")
    upto = F.greatest(_period(F.least(F.coalesce("valid_to", last), last)), _period(F.col("valid_from")))
    cut = spans.where(F.col("valid_from") <= last).withColumn("period", F.explode(F.sequence(_period(F.col("valid_from")), upto)))
    # Running numbers are written before the plan branches: both branches then read the same ones.
    rows = written(captures.withColumn("__row", F.monotonically_increasing_id()), "captures")
    asked = rows.select("__row", F.col(time_col).alias("at"), F.explode(keys(F.col(url_col))).alias("key")).withColumn("period", _period(F.col("at")))
    active = asked.join(cut, ["key", "period"]).where("valid_from <= at and (valid_to is null or at < valid_to)")
    found = active.groupBy("__row").agg(F.count("*").alias("__n"), F.array_sort(F.collect_set("list")).alias("__lists"), F.array_sort(F.collect_set("key")).alias("__keys"))
    out = rows.join(found, "__row", "left")
    return out.select(
        *kept,
        host(F.col(url_col)).alias("host"),
        F.col("__n").isNotNull().alias("blocked"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce(F.array_join("__lists", ","), F.lit("")).alias("lists"),
        F.coalesce(F.array_join("__keys", ","), F.lit("")).alias("matched_keys"),
    )
