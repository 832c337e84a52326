"""Figures kept up to date from a stream of contact rows.

``accumulated`` keeps additive figures: each micro-batch is aggregated alone and added to the groups held so far, so a batch
costs its own rows and the number of groups, never the rows before. ``refreshed`` is for plans that do not add up: it keeps
the rows and runs the batch plan over all of them. Both write a new version per batch, so readers never meet a half-written
table and a batch that is run twice replaces itself. ``arrivals`` is a streaming aggregate proper, with late rows dropped
by watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _versions(spark: SparkSession, out: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    # a version counts once its writer has finished
    return sorted(int(n[8:]) for n in names if n.startswith("version-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS")))


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest finished version."""
    return spark.read.parquet(f"{out}/version-{_versions(spark, out)[-1]}")


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def accumulated(stream: DataFrame, keys: list[str], sums: dict[str, str], out: str, checkpoint: str) -> StreamingQuery:
    """Sums (name -> SQL expression of a row) by ``keys``, kept in ``out``; the last two versions stay."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        part = batch.groupBy(*keys).agg(*[F.sum(F.expr(e)).cast("double").alias(n) for n, e in sums.items()])
        held = [v for v in _versions(spark, out) if v < epoch]
        if held:
            part = part.unionByName(spark.read.parquet(f"{out}/version-{held[-1]}")).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
        part.write.mode("overwrite").parquet(f"{out}/version-{epoch}")
        for v in held[:-1]:
            _drop(spark, f"{out}/version-{v}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(stream: DataFrame, store: str, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to ``store`` (a batch written twice replaces itself) and write ``plan(all rows)`` as the
    newest version of ``out``."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        plan(spark.read.schema(batch.schema).parquet(store)).write.mode("overwrite").parquet(f"{out}/version-{epoch}")
        for v in [v for v in _versions(spark, out) if v < epoch - 1]:
            _drop(spark, f"{out}/version-{v}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(hits: DataFrame, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Hits per window of crawl time and kind of mailbox."""
    timed = hits.withColumn("crawled_at", F.col("crawled_at").cast("timestamp")).withWatermark("crawled_at", late)
    return timed.groupBy(F.window("crawled_at", width).alias("w"), "is_role").agg(F.count("*").alias("n")).select("w.start", "is_role", "n")
