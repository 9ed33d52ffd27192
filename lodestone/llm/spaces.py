"""Tables that operators write on the way, in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path. It cuts the lineage, and any
    executor may be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession):
    """Gives a function that writes a table as written() does; the tables go at the end of the block."""
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        out, path = written(df)
        paths.append(path)
        return out

    try:
        yield put
    finally:
        for path in paths:
            delete(spark, path)


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df in bytes (for a file scan, the files' size), or 2000 a row where it has none.
    It only sizes partitions."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else 2000 * df.count()
