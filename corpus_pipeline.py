"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and is written as Parquet before the next one reads it. All but the last
return the columns of ``documents`` named in ``COLUMNS``; other columns are dropped.

Defined results follow from the operators: null texts are scored by the prior of the
classifier, and those that stay are one group of empty texts; of equal or near texts
the row with the smallest id stays; null sources and languages are kept as such; rows
repeated by the mix are rows of their own; very long texts are treated whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality, sharding, simhash
from tidemark.llm.common import clear, made, new_path, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at least 0.8 alike."""
    return simhash.keep_unlike(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    marked = decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return marked.where("not contaminated").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mixing.mix(docs, keep=COLUMNS).where("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), "copies")).alias("__copy")).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and their slot in it."""
    return sharding.shard(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("source mix", mixed),
    ("sharding", sharded),
]

#: The classifier's scores cannot be expressed in SQL; tests/llm compare run()
#: with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. A stage's intermediate tables, and its predecessor's
    result, are removed when its own result is written."""
    docs, since = read_table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        out = new_path(spark, name.replace(" ", "-"))
        rows.write.parquet(out)
        clear(spark, since, (out,))
        docs = spark.read.parquet(out)
    return docs
