"""Spark helpers: the shared folder, lineage cuts and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local, as in tests, a new local folder."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not told and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-"))
    return told or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read from there: what follows doesn't run it again, and
    plans it by its real size.  Row groups are small, so that tasks share a table of large rows evenly."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(col: str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def as_struct(docs: DataFrame) -> DataFrame:
    """One column ``doc``, a struct of all columns, whatever their names; ``doc.*`` gives them back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


#: Rows from which a key may count as common.
COMMON = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with the facts of their key, and ``common``: whether very many rows have it.

    facts (a written table): one row per key; its column ``n`` is the number of
    rows with that key.  One that more than a 5000th of all rows have is common;
    there are 5000 such at most, so their facts are broadcast, and no task gets
    all the rows of one of them.
    """
    total = facts.agg(F.sum(n).alias("s")).head()["s"] or 0
    most = max(COMMON, total // 5000)
    few = F.broadcast(facts.where(F.col(n) > most))
    common = rows.join(few, key).withColumn("common", F.lit(True))
    others = rows.join(few.select(key), key, "left_anti").join(facts.where(F.col(n) <= most), key).withColumn("common", F.lit(False))
    return common.unionByName(others)


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b) long pairs -> (id, component): the smallest id reachable; ids without a pair to another don't appear.

    Each round points every node at its smallest neighbour, follows the pointers
    twice and contracts the pairs, so the number of nodes at least halves per
    round; minima combine before the shuffle, so hubs cost no more than others.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs)
    found = None
    for _ in range(max_rounds):
        if pairs.isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("p"))
        up = point.select(F.col("id").alias("p"), F.col("p").alias("q"))
        point = cut(point.join(up, "p").select("id", F.col("q").alias("p")))
        if found is None:
            found = point.withColumnRenamed("p", "component")
        else:
            to = point.select(F.col("id").alias("component"), "p")
            found = found.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        a, b = (point.select(F.col("id").alias(x), F.col("p").alias("p" + x)) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b").where("pa <> pb")
        pairs = cut(pairs.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    if found is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return cut(found)
