"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives the loss of executors. The cluster names
the folder in ``spark.checkpoint.dir``. Tables are needed until the result that
reads them is consumed; ``clear`` removes those of this application afterwards.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only in local mode, where it is unset, one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # The setting cannot be changed in a running session, so that the folder is kept here.
        path = _local.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="tidemark-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed by ``clear``."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Unlike ``checkpoint()`` the plan runs once, and the files are columnar.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove this application's intermediate tables but the first ``since`` and those in
    ``keep``: for callers that have consumed (written, collected) what reads them."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    for path in [p for p in paths[since:] if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)


def made(spark: SparkSession) -> int:
    """How many intermediate tables there are: ``clear`` takes this as ``since``."""
    return len(_made.get(spark.sparkContext.applicationId, []))
