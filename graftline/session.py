"""Session helpers: table access and scratch tables in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Unset, a local session gets a temporary folder; on a cluster a machine-local folder would not
    be seen by other executors, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="graftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/graftline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/graftline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that a balanced stage should have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@lru_cache(maxsize=1)
def _archive() -> str:
    """A zip of this package, made once by the driver; Spark's file server hands it to the executors."""
    package = os.path.dirname(os.path.abspath(__file__))
    where = os.path.join(tempfile.mkdtemp(prefix="graftline-code-"), "graftline")
    return shutil.make_archive(where, "zip", os.path.dirname(package), os.path.basename(package))


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, wherever they run; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_graftline_shipped", None) != context.applicationId:
        context.addPyFile(_archive())
        context._graftline_shipped = context.applicationId
