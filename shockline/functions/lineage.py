"""Cutting the lineage of iterative jobs."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local, as in tests, a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, *keys: str, path: str | None = None, dealt: bool = False) -> DataFrame:
    """df, written in buckets of the keys, so that joins on them don't shuffle it again; ``dealt``: it lies by the keys already.

    Buckets aren't sorted: readers don't rely on their order and sort again.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).option("path", path or f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and the plan knows them
    return table
