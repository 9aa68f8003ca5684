"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import clear, made, new_path, shared_dir, written  # noqa: F401

HOT_ROWS = 512
HOT_KEYS = 10_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application.

    Spark serves the archive from the driver, so workers need no PYTHONPATH."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_limit(total: int, rows: int = HOT_ROWS, keys: int = HOT_KEYS) -> int:
    """More rows than this make a key hot: at most ``keys`` keys of ``total`` rows can be."""
    return max(rows, total // keys)


def join_by_size(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows.join(table, on)`` where ``table`` has one row a key and its column ``size``
    says how many of the ``total`` rows it meets (any bound from above may be given).

    Hot keys are at most HOT_KEYS many, so their part of ``table`` is broadcast and
    their rows stay where they are; only the other rows are shuffled by key. Both
    sides are read twice and should be written tables. Keys must not be null."""
    limit = hot_limit(total, hot_rows)
    hot, cold = F.broadcast(table.where(F.col(size) > limit)), table.where(F.col(size) <= limit)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def numbered(rows: DataFrame, keys: list[str], row: str, size: str, name: str, cell_rows: int = 4096) -> DataFrame:
    """Number the rows of each key from 0 without gaps, as the long ``name``.

    ``size`` holds the number of rows of the key, ``row`` a number of the row's own.
    A key of many rows is dealt into cells of about ``cell_rows`` rows, whose counts
    shift the numbers within each cell, so that no task orders a whole key."""
    dealt = rows.withColumn("__cell", F.pmod(F.xxhash64(row), 1 + F.floor(F.col(size) / F.lit(cell_rows))))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "__cell").agg(F.count("*").alias("__c"))
    offsets = counts.select(*keys, "__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(row)) - 1
    placed = dealt.withColumn("__within", within).join(offsets, [*keys, "__cell"])
    return placed.withColumn(name, (F.col("__offset") + F.col("__within")).cast("long")).drop("__cell", "__within", "__offset")


def with_arrow_columns(
    df: DataFrame,
    text_col: str,
    added: T.StructType,
    fn: Callable[..., dict[str, list]],
    keep: Sequence[str] | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """Append columns that ``fn`` derives from the UTF-8 bytes of ``text_col``
    and from the columns named in ``also``, which it gets as lists.

    Rows stay in their partitions (no shuffle). ``keep`` names the input
    columns to return, all by default. Input columns that carry the name of an
    added one are replaced by it.
    """
    names = {f.name for f in added.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    source = df.select(*kept, F.col(text_col).cast("binary").alias("__bytes"), *(F.col(c).alias(f"__also_{c}") for c in also))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(batch.column("__bytes").to_pylist(), *(batch.column(f"__also_{c}").to_pylist() for c in also))
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(got[f.name], type=arrow.field(f.name).type) for f in added.fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in added.fields)])

    return source.mapInArrow(run, schema)
