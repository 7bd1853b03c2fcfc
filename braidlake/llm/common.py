"""What the operators share: reading tables, cutting lineage, and getting this package to the workers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: whole texts may be long, so batches are short.
BATCH_ROWS = 256
_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches (unless the caller has set a size), and modules that workers can load.

    Workers that don't have the repository on their path get the functions by value.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        for name, module in list(sys.modules.items()):
            if name.startswith(__package__):
                cloudpickle.register_pickle_by_value(module)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, a new one if all run in one process."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="braidlake-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and any executor can read it.

    The folder goes when the driver ends, or with release().
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    fs, path = _path(spark, at)
    df.write.parquet(at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._braidlake_at = at
    return out


def release(*staged: DataFrame) -> None:
    """Deletes what stage() has written, of tables that nothing will read again."""
    for df in staged:
        fs, path = _path(df.sparkSession, df._braidlake_at)
        fs.delete(path, True)


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the given ones, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def schema_of(docs: DataFrame, columns: list[str]) -> str:
    """DDL of these columns, each with a comma behind it."""
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
