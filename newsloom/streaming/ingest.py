"""Incremental ingestion: a file stream, state for duplicates, and the same merge folds as in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge


#: Buckets of keys that a merged table is kept in, versions of a bucket that stay.
BUCKETS, KEPT = 64, 2


def files(source_dir: str, schema: str, spark: SparkSession, most_files: int = 100) -> DataFrame:
    """A stream of JSON files, of which a batch takes `most_files`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(source_dir)


def upsert_stream(source: DataFrame, target: str, checkpoint: str, keys: Sequence[str], rules: dict[str, str], order: str = "seq", buckets: int = BUCKETS) -> StreamingQuery:
    """Folds each batch of source into a table under target that is kept in buckets of key hashes; table() reads it.

    A batch writes new versions of the buckets that its keys are in, from the versions before it, and of no others. A batch that
    runs again writes its own versions anew, so nothing is folded twice. Versions that no batch needs any more are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` rows
        if not touched:
            return
        held = {b: [p for n, p in found if n < epoch] for b, found in versions(spark, target).items() if b in touched}
        paths = [own[-1] for own in held.values() if own]
        stored = spark.read.option("basePath", target).parquet(*paths).drop("version") if paths else new.limit(0)
        folded = merge.fold(stored, new, ["bucket", *keys], rules, order)
        folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={epoch:09d}")
        for b, found in versions(spark, target).items():
            for _, old in found[:-KEPT] if b in touched else []:
                path = spark._jvm.org.apache.hadoop.fs.Path(old)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> dict[int, list[tuple[int, str]]]:
    """Of each bucket, (batch, path) of its finished versions, the oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[tuple[int, str]]] = {}
    for version in fs.listStatus(hadoop(target)) if fs.exists(hadoop(target)) else []:
        if "version=" in version.getPath().getName() and fs.exists(hadoop(version.getPath(), "_SUCCESS")):
            number = int(version.getPath().getName().partition("=")[2])
            for part in fs.listStatus(version.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket="):
                    out.setdefault(int(name.partition("=")[2]), []).append((number, str(part.getPath())))
    return {b: sorted(found) for b, found in out.items()}


def table(spark: SparkSession, target: str) -> DataFrame:
    """The merged table: the newest version of each bucket."""
    paths = [found[-1][1] for found in versions(spark, target).values()]
    return spark.read.option("basePath", target).parquet(*paths).drop("version", "bucket")


def distinct_posts(source: DataFrame, late: str = "7 days", url: str = "url", at: str = "published_at") -> DataFrame:
    """Each address once within the watermark."""
    return source.withWatermark(at, late).dropDuplicatesWithinWatermark([url])


def activity(source: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", at: str = "happened") -> DataFrame:
    """Counts by window and kind; late events within the watermark are added."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return source.withWatermark(at, late).groupBy(window.alias("w"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "value")


def sessions(source: DataFrame, gap: str = "30 minutes", late: str = "2 hours", at: str = "happened") -> DataFrame:
    """Sessions of each user, closed after a gap."""
    return source.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
