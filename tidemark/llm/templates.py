"""Line dedup by a log-template tree.

A line's words, with words that hold a digit masked, lead down a tree of fixed
depth: number of words, then the first ``DEPTH`` words. A leaf may hold many
templates. For each position of a leaf its words are counted, and a line is
generalised on several levels: on level k a word stays if the lines that have it
there are at least the share ``SHARES[k]`` of the leaf (and ``min_docs`` of them), and
is variable otherwise. The first level keeps what most lines of the leaf have, the
last what is frequent at all, so neither one common line nor a crowd of other
templates hides a template. A generalised line is a template if at least ``SIMILAR``
of its words are fixed; the line itself is always one. Templates found in
``MIN_DOCS`` documents or more recur, and their lines are dropped from every document.

All steps are counts by keys, combined before each shuffle: leaves with too few
documents go first, equal lines travel once with their count, a leaf's words are
counted for each (leaf, position, word), never as lists of lines. Lines of very
many documents meet their templates by broadcast (there are few of them).

Defined results: null texts have no lines and stay empty; lines without words
stay; words are counted by the rows that hold their line; rows with one doc_id count as
one document, rows without are documents of their own; an empty table gives an empty result; very
long texts and lines are treated whole, a busy line as an array as long as it is; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_size, written

DEPTH = 3
MIN_DOCS = 8
SIMILAR = 0.7
SHARES = (1 / 2, 1 / 8, 1 / 32, 0.0)
WILD = "<*>"


def masked_lines(text: Column) -> Column:
    """The words of each line joined by one space, those with a digit masked."""
    bare = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")
    hidden = F.regexp_replace(bare, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILD)
    return F.transform(F.split(hidden, "\n", -1), lambda line: F.trim(line))


def _leaf(line: Column) -> Column:
    """Hash of the path in the tree."""
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(words, F.substring_index(line, " ", DEPTH))


def _lines(base: DataFrame) -> DataFrame:
    """(row, unit, leaf, line, masked): the distinct masked lines of each row."""
    exploded = base.select("row", "unit", F.explode(F.array_distinct(masked_lines(F.col("text")))).alias("masked")).where("masked <> ''")
    return exploded.select("row", "unit", _leaf(F.col("masked")).alias("leaf"), F.xxhash64("masked").alias("line"), "masked")


def _templates(variants: DataFrame, min_docs: int, similar: float) -> DataFrame:
    """(line, n, templates) of the distinct lines (leaf, line, masked, n) of busy leaves."""
    words = variants.select("leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("pos", "word"))
    counts = words.groupBy("leaf", "pos", "word").agg(F.sum("n").alias("c")).where(F.col("c") >= min_docs)
    sizes = variants.groupBy("leaf").agg(F.sum("n").alias("all"))
    # The first level on which a word stays; words that are nowhere frequent never do.
    level = F.lit(len(SHARES))
    for k, share in reversed(list(enumerate(SHARES))):
        level = F.when(F.col("c") >= F.col("all") * share, k).otherwise(level)
    frequent = written(counts.join(sizes, "leaf").select("leaf", "pos", "word", level.alias("level")), "frequent-words")
    known = words.join(frequent, ["leaf", "pos", "word"], "left").select("line", "leaf", "n", F.struct("pos", "word", F.coalesce("level", F.lit(len(SHARES))).alias("level")).alias("w"))
    lines = known.groupBy("line", "leaf", "n").agg(F.array_sort(F.collect_list("w")).alias("ws"))  # as long as one line

    def template(k: int) -> Column:
        fixed = F.size(F.filter("ws", lambda w: w["level"] <= k))
        shape = F.array_join(F.transform("ws", lambda w: F.when(w["level"] <= k, w["word"]).otherwise(F.lit("\n"))), " ")
        return F.when(fixed >= similar * F.size("ws"), F.xxhash64("leaf", shape))

    own = F.xxhash64("leaf", F.array_join(F.transform("ws", lambda w: w["word"]), " "))
    every = F.array_distinct(F.array_compact(F.array(*map(template, range(len(SHARES))), own)))
    return lines.select("line", "n", every.alias("templates"))


def recurring(base: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """(row, line): hashes of the masked lines of each row of ``base`` (row, unit, text) that are dropped."""
    lines = written(_lines(base), "lines")
    busy = written(lines.groupBy("leaf").agg(F.countDistinct("unit").alias("units")).where(F.col("units") >= min_docs).select("leaf"), "leaves")
    held = lines.join(busy, "leaf", "left_semi")
    variants = written(held.groupBy("leaf", "line", "masked").agg(F.count("*").alias("n")), "variants")
    of = written(_templates(variants, min_docs, similar), "templates")
    # Templates of too few rows cannot recur; the others are counted by documents.
    likely = of.select("line", "n", F.explode("templates").alias("template"))
    likely = written(likely.groupBy("template").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_docs), "likely")
    total = lines.count()
    asked = join_by_size(of.select("line", "n", F.explode("templates").alias("template")), likely.withColumnRenamed("rows", "members"), ["template"], "members", total)
    asked = written(asked.groupBy("line", "n").agg(F.collect_set("template").alias("templates")), "asked")  # at most one a level
    thin = lines.select("row", "unit", "line")
    met = join_by_size(thin, asked, ["line"], "n", total).select("unit", F.explode("templates").alias("template"))
    common = met.distinct().groupBy("template").agg(F.count("*").alias("units")).where(F.col("units") >= min_docs)
    common = written(common.select("template"), "common")
    gone = asked.select("line", "n", F.explode("templates").alias("template")).join(likely, "template")
    gone = join_by_size(gone.select("line", "n", "template"), common.join(likely, "template"), ["template"], "rows", total)
    gone = written(gone.groupBy("line").agg(F.max("n").alias("n")), "gone")
    return join_by_size(thin.select("row", "line"), gone, ["line"], "n", total).select("row", "line")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_text."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    unit = F.when(F.col("id").isNull(), F.concat(F.lit("row "), F.col("row").cast("string"))).otherwise(F.col("id").cast("string"))
    base = written(base.withColumn("unit", unit), "documents")
    gone = recurring(base, min_docs, similar).groupBy("row").agg(F.collect_set("line").alias("gone"))
    joined = base.join(gone, "row", "left")
    lines = F.split("text", "\n", -1)
    paired = F.zip_with(lines, masked_lines(F.col("text")), lambda raw, masked: F.struct(raw.alias("raw"), F.xxhash64(masked).alias("line")))
    some = F.transform(F.filter(paired, lambda p: ~F.array_contains("gone", p["line"])), lambda p: p["raw"])
    kept = F.when(F.col("gone").isNull(), lines).otherwise(some)
    counted = joined.select("id", "text", F.size(lines).alias("n"), kept.alias("kept"))
    return counted.select(
        F.col("id").alias(id_col),
        F.when(F.col("text") == "", 0).otherwise(F.col("n")).cast("long").alias("n_lines"),
        (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )
