"""Meeting activity by month and firm, and whom to follow up first."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import safe_ratio
from .dashboard import with_firm
from .derive import attended_names, days_since, n_attended, named
from .ranking import global_rank, top


def monthly_activity(contacts: DataFrame, as_of: datetime.date, months: int = 18) -> DataFrame:
    """month, contacts, cumulative over a spine of months that ends in the current one. The range test
    becomes an equality on the month."""
    spine = contacts.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(F.trunc(F.lit(as_of), "MM"), 1 - months), F.trunc(F.lit(as_of), "MM"), F.expr("interval 1 month"))).alias("month"))
    got = named(contacts).filter("lastmtg is not null").groupBy(F.trunc("lastmtg", "MM").alias("month")).agg(F.count("*").alias("n"))
    out = spine.join(got, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("contacts"))
    return out.withColumn("cumulative", F.sum("contacts").over(W.orderBy("month")))  # one row per month


def firm_coverage(contacts: DataFrame, as_of: datetime.date, firms: DataFrame | None = None) -> DataFrame:
    """Meetings by firm; with ``firms`` (column firm) those without contacts too, and place by (meetings, firm)."""
    rows = with_firm(named(contacts)).select("firm", "met", "mtgs", "lastmtg", n_attended().alias("a"))
    got = rows.groupBy("firm").agg(
        F.count("*").alias("contacts"), F.count_if(F.col("met") == "Yes").alias("met"), F.coalesce(F.sum("mtgs"), F.lit(0)).alias("meetings"), F.max("lastmtg").alias("last_meeting"), F.count_if(F.col("a") > 0).alias("attended")
    )
    if firms is not None:
        got = firms.select("firm").filter("firm is not null").distinct().join(got, "firm", "full").na.fill(0, ["contacts", "met", "meetings", "attended"])
    out = got.withColumn("coverage", F.round(safe_ratio(F.col("met"), F.col("contacts")), 6)).withColumn("days_since", F.datediff(F.lit(as_of), F.col("last_meeting")))
    return out if firms is None else global_rank(out, [F.desc("meetings"), F.asc("firm")], "place")


def follow_up(contacts: DataFrame, event_slots: DataFrame, as_of: datetime.date, k: int | None = 15) -> DataFrame:
    """Contacts that were met, longest ago first, ties by row number; k None ranks all."""
    met = named(contacts).filter("met = 'Yes' and lastmtg is not null")
    order = [F.asc("lastmtg"), F.asc("row_no"), F.asc("contact_id")]
    cols = ["contact_id", "name", "firm", "lastmtg", days_since(as_of).alias("days_since"), attended_names(event_slots).alias("attended_events"), "invested", "email"]
    if k is None:
        return global_rank(met, order, "place").select("place", *cols)
    first = top(met, order, k)
    return first.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("bigint")).select("place", *cols)  # k rows
