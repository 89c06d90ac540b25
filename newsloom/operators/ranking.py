"""Ranks without a task that holds all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SALTS = 64


def checkpoints(spark: SparkSession) -> None:
    """Makes sure of a checkpoint folder: the one that the session names; a local session has a default."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(named or "file:///tmp/checkpoints")


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each key, with their rank: first among the rows of a salt, then among those that are left."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    near = salted.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col(rank) <= most).drop("__salt")
    return near.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def positions(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """rows with their place in the whole order, from 1: ranges are sorted apart, and each begins after the sizes of those before."""
    checkpoints(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts or [(0, 0)], "__part long, __before long")
    placed = dealt.join(F.broadcast(offsets), part == F.col("__part"))
    return placed.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
