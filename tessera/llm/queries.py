"""Queries of this subpackage: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import p01_canonical_text as p01
from . import p02_formatting_duplicates as p02
from . import p03_name_variants as p03
from . import p04_cross_source as p04
from . import p05_incremental as p05
from . import p06_reference_mapping as p06
from . import p07_survivors as p07
from . import p08_tokenize as p08
from . import p09_leakage as p09
from . import p10_truncation as p10


def _names(spark: SparkSession, d: str) -> DataFrame:
    contacts = table(spark, d, "contacts").select(F.lit("contacts").alias("src"), F.col("contact_id").alias("row_id"), "name")
    hits = table(spark, d, "hits").select(F.lit("hits").alias("src"), F.col("hit_id").alias("row_id"), F.col("nearby_name").alias("name"))
    return p01.with_canonical(contacts.unionAll(hits), "name", "canonical_name", "changed")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).filter("changed").select("src", "row_id")


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("src", "row_id", "canonical_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p02.copies_found(table(spark, d, "contacts"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return p02.records(table(spark, d, "contacts"))


def _people_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("contacts", "hits", "firm_ref", "short_names")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p03.found(*_people_tables(spark, d))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return p03.members(*_people_tables(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p04.matched_rows(*_people_tables(spark, d)).select("contact_id", "hit_id")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    return p04.matched_rows(*_people_tables(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p05.hits_found(table(spark, d, "contacts"), table(spark, d, "hits"))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    return p05.hits_by_batch(table(spark, d, "contacts"), table(spark, d, "hits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p06.firms_found(table(spark, d, "contacts"), table(spark, d, "firm_ref"))


def _survivors(spark: SparkSession, d: str, currency: bool) -> DataFrame:
    return p07.survivors(table(spark, d, "contacts"), table(spark, d, "dup_groups"), table(spark, d, "source_trust"), currency)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, False).select("group_id", "field_name", "contact_id")


def p7_current(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, True)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p08.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p09.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return p09.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10.found(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return p10.shares(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p2_records, p3_found, p3_members, p4_found, p4_matches, p5_found, p5_batches, p6_found, p7_found, p7_current, p8_ids, p9_found, p9_clean, p10_found, p10_shares)}
