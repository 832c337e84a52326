"""Classification of addresses, hits kept once, and the import set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails
from ..functions.names import name_tokens
from .ranking import global_rank


def classified(rows: DataFrame, domain_mx: DataFrame, column: str = "email") -> DataFrame:
    """Add email (tidy), syntax_ok, has_mx (null: not looked up), flags, sendable and note."""
    mx = domain_mx.select(F.lower("domain").alias("__d"), "has_mx").dropDuplicates(["__d"])
    e = F.col("__e")
    out = rows.withColumn("__e", emails.tidy(F.coalesce(F.col(column), F.lit("")))).withColumn("syntax_ok", e.rlike(emails.SYNTAX))
    out = out.withColumn("__m", F.when(F.col("syntax_ok"), emails.domain(e))).join(mx, F.col("__m") == F.col("__d"), "left")
    domain = emails.domain(e)
    ok, has = F.col("syntax_ok"), F.col("has_mx")
    out = out.withColumn("is_role", ok & emails.is_role(emails.local(e))).withColumn("is_free", F.coalesce(emails.is_free(domain), F.lit(False))).withColumn("is_disposable", F.coalesce(domain.isin(*emails.DISPOSABLE), F.lit(False)))
    note = (
        F.when(~ok, "malformed").when(F.col("is_disposable"), "disposable domain").when(~has, "domain accepts no mail").when(has.isNull(), "MX lookup failed")
        .when(F.col("is_role"), "role account (a desk, not a person)").when(F.col("is_free"), "personal free mailbox").otherwise("ok")
    )
    out = out.withColumn("sendable", ok & F.coalesce(has, F.lit(False)) & ~F.col("is_disposable")).withColumn("note", note)
    return out.withColumn(column, e).drop("__e", "__m", "__d")


def kept_once(hits: DataFrame, id_column: str = "hit_id") -> DataFrame:
    """One hit per address: the first that has a name, else the first. Reduced map-side."""
    named = F.col("nearby_name").isNotNull() & (F.col("nearby_name") != "")
    order = F.struct((~named).alias("bare"), F.col(id_column))
    return hits.withColumn("email", emails.tidy(F.col("email"))).groupBy("email").agg(F.min_by(F.struct(*[c for c in hits.columns if c != "email"]), order).alias("h")).select("email", "h.*")


def ordered_hits(hits: DataFrame, id_column: str = "hit_id") -> DataFrame:
    """Hits kept once with their place: personal addresses first, then by address."""
    return global_rank(kept_once(hits, id_column).withColumn("is_role", F.coalesce("is_role", F.lit(False))), [F.asc("is_role"), F.asc("email")], "place")


def import_set(known: DataFrame, predictions: DataFrame, crawled: DataFrame) -> DataFrame:
    """Predictions, then crawled hits, whose address is not held yet and whose status lets them through,
    each address once; joined to the contact of the same name.

    known: id, name, email, firm, ctype. predictions: id, name, firm, email, confidence_pct, status.
    crawled: id, name, email, found_on, status."""
    kinds = [
        predictions.select(F.lit(0).alias("rank"), "id", "name", "firm", "email", "status", F.concat(F.lit("Pattern prediction; confidence "), F.col("confidence_pct").cast("string"), F.lit("%")).alias("notes"), F.lit("Pattern prediction").alias("source")),
        crawled.select(F.lit(1).alias("rank"), "id", "name", F.lit(None).cast("string").alias("firm"), "email", "status", F.concat(F.lit("Website: "), F.coalesce("found_on", F.lit(""))).alias("notes"), F.lit("Website").alias("source")),
    ]
    rows = kinds[0].unionByName(kinds[1]).withColumn("email", emails.tidy(F.col("email"))).filter("email <> '' and coalesce(status, '') in ('ok', 'unverified prediction', '')")
    held = known.filter(F.contains("email", F.lit("@"))).select(F.lower("email").alias("email")).distinct()
    rows = rows.join(held, "email", "left_anti")
    rows = rows.groupBy("email").agg(F.min_by(F.struct("rank", "name", "firm", "notes", "source"), F.struct("rank", "id")).alias("r")).select("email", "r.*")
    key = F.nullif(F.array_join(name_tokens(F.col("name")), ""), F.lit(""))
    people = known.select(key.alias("k"), "id", F.col("firm").alias("held_firm"), F.col("ctype").alias("held_ctype")).filter("k is not null")
    people = people.groupBy("k").agg(F.max_by(F.struct("held_firm", "held_ctype"), "id").alias("p")).select("k", "p.*", F.lit(True).alias("there"))
    out = rows.withColumn("k", key).join(people, "k", "left")
    return out.select(
        F.coalesce(F.nullif("name", F.lit("")), emails.local(F.col("email"))).alias("name"), "email", F.coalesce(F.nullif("firm", F.lit("")), "held_firm").alias("firm"), F.coalesce("held_ctype", F.lit("Adviser")).alias("ctype"),
        "source", F.lit("No").alias("met"), F.lit("No").alias("invested"), F.substring("notes", 1, 250).alias("notes"), F.when(F.col("there"), "yes - fills a blank email").otherwise("no - new contact").alias("already_held"),
    )


def page_counters(hits: DataFrame, site: str, closed: tuple[str, ...]) -> DataFrame:
    """site, pages, blocked: different pages, and those whose path a site's rules close to readers (by its beginning)."""
    path = F.regexp_extract("source_url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    pages = hits.filter("source_url is not null").select(site, "source_url", path.alias("path")).distinct()
    shut = F.lit(False)
    for c in closed:
        shut = shut | F.col("path").startswith(c)
    return pages.groupBy(site).agg(F.count("*").alias("pages"), F.count_if(shut).alias("blocked"))


def crawl_counters(hits: DataFrame, site: str) -> DataFrame:
    """site, pages, hits, personal: what was read per site."""
    return hits.groupBy(site).agg(F.countDistinct("source_url").alias("pages"), F.count("*").alias("hits"), F.count_if(~F.col("is_role")).alias("personal"))
