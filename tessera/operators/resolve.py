"""Union of sources and order-dependent entity resolution in closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import person_key
from ..model import EVENTS, FIELDS, NOT_INVITED, UNKNOWN
from ..session import written


def union_sources(*sources: DataFrame) -> DataFrame:
    """Contact records of all sources with ``ord``, their place by (src_rank, row_no)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return rows.withColumn("ord", F.col("src_rank").cast("bigint") * 10**12 + F.col("row_no"))


def clusters(rows: DataFrame) -> DataFrame:
    """Add key and cluster_firm. A record joins its own firm's slot if that was opened before the slot of
    the firm Unknown, else the Unknown slot. The first records per (key, firm) are found map-side."""
    rows = rows.withColumn("key", F.coalesce(person_key(F.col("name")), F.concat(F.lit("row "), F.col("ord").cast("string"))))
    first = rows.groupBy("key", "firm").agg(F.min("ord").alias("first_f"))
    unknown = first.filter(F.col("firm") == UNKNOWN).select("key", F.col("first_f").alias("t_u"))
    slot = first.join(unknown, "key", "left").select(
        "key", "firm", F.when(F.col("t_u").isNull() | (F.col("firm") == UNKNOWN) | (F.col("first_f") < F.col("t_u")), F.col("firm")).otherwise(UNKNOWN).alias("cluster_firm")
    )
    return rows.join(slot, ["key", "firm"])


def _first(column: str, empty: tuple = ("",)) -> Column:
    c = F.col(column)
    usable = c.isNotNull() & ~c.isin(*empty)
    return F.min_by(c, F.when(usable, F.col("ord"))).alias(column)


def _joined(rows: DataFrame, column: str, separator: str) -> DataFrame:
    """key, cluster_firm, column: texts in order of first appearance, left out if already contained. Only
    distinct texts are gathered."""
    seen = rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("key", "cluster_firm", column).agg(F.min("ord").alias("o"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("o", column))), lambda s: s[column])
    fold = F.aggregate(sorted_, F.lit(""), lambda a, n: F.when(F.contains(a, n), a).when(a == "", n).otherwise(F.concat(a, F.lit(separator), n)))
    return seen.groupBy("key", "cluster_firm").agg(fold.alias(column))


def resolve(rows: DataFrame) -> DataFrame:
    """One record per (key, cluster_firm): the first usable value field by field, notes and sources joined;
    n_rows and the place of the first row."""
    placed = written(clusters(rows), "placed")  # read by the fields, the notes and the sources
    plain = [f for f in FIELDS if f not in ("firm", "mtgs", "notes", "source", *EVENTS)]
    numeric = {f for f, t in rows.dtypes if t not in ("string",)}
    out = placed.groupBy("key", "cluster_firm").agg(
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) if f in numeric else _first(f) for f in plain],
        F.coalesce(F.min_by("mtgs", F.when(F.col("mtgs") != 0, F.col("ord"))), F.lit(0)).alias("mtgs"),
        *[F.coalesce(F.min_by(F.col(e), F.when(F.col(e) != NOT_INVITED, F.col("ord"))), F.lit(NOT_INVITED)).alias(e) for e in EVENTS],
        F.min("ord").alias("ord"),
        F.count("*").alias("n_rows"),
    )
    for column, separator in (("notes", "; "), ("source", " + ")):
        out = out.join(_joined(placed, column, separator), ["key", "cluster_firm"], "left")
    return out.withColumnRenamed("cluster_firm", "firm").select(*FIELDS, "key", "ord", "n_rows")


def tidied(contacts: DataFrame) -> DataFrame:
    """A date or a meeting means met; met means a meeting; blanks take their defaults."""
    held = F.col("lastmtg").isNotNull() | (F.coalesce("mtgs", F.lit(0)) > 0)
    met = F.when(held, "Yes").otherwise(F.coalesce(F.nullif("met", F.lit("")), F.lit("No")))
    return (
        contacts.withColumn("met", met)
        .withColumn("mtgs", F.when((F.col("met") == "Yes") & (F.coalesce("mtgs", F.lit(0)) == 0), 1).otherwise(F.coalesce("mtgs", F.lit(0))))
        .withColumn("invested", F.coalesce(F.nullif("invested", F.lit("")), F.lit("No")))
        .withColumn("mailsent", F.coalesce(F.nullif("mailsent", F.lit("")), F.when(F.col("source").startswith("Mass Email"), "Yes")))
    )
