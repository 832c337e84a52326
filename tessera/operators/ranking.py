"""Global ranks and running counts without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 1-based place of each row by ``order`` (which must end in a unique column).

    Rows are range-partitioned and written once, so the ranges stay as they are; each range is ranked
    alone and lifted by the number of rows in the ranges before it (one row per range, broadcast).
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(W.orderBy("__range")) - F.col("n")).alias("__before"))
    ranked = ranged.withColumn("__place", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    # a row per range: its size is the number of partitions
    return ranked.join(F.broadcast(before), "__range").withColumn(out, (F.col("__place") + F.col("__before")).cast("bigint")).drop("__range", "__place", "__before")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows: taken per partition, then of those; nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)
