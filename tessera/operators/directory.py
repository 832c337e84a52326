"""The filterable directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ALL, STAGES
from .dashboard import with_firm
from .derive import attended_names, engagement, named
from .ranking import global_rank


def _is(column: str, wanted: str) -> Column:
    return F.lit(True) if wanted == ALL else F.coalesce(F.lower(column) == wanted.lower(), F.lit(False))


def _holds(column: Column, wanted: str) -> Column:
    """Substring without case; ? is any character and * any run, as in a search box."""
    if not any(c in wanted for c in "?*"):
        return F.coalesce(F.contains(F.lower(column), F.lit(wanted.lower())), F.lit(False))
    like = wanted.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return F.coalesce(F.lower(column).like(f"%{like}%"), F.lit(False))


def passing(contacts: DataFrame, event_slots: DataFrame, firm: str = ALL, met: str = ALL, event: str = ALL, stage: str = ALL, text: str = "") -> DataFrame:
    """Contacts that pass all five filters; (All) and a blank text pass everything."""
    rows = named(contacts).withColumn("attended_events", attended_names(event_slots)).withColumn("engagement", engagement())
    rows = rows.filter(_is("firm", firm) & _is("met", met) & _is("engagement", stage))
    if event != ALL:
        rows = rows.filter(_holds(F.col("attended_events"), event))
    if text:
        rows = rows.filter(_holds(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "email", "firm", "notes")]), text))
    return rows


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Place by firm and name without case, then row number."""
    keyed = rows.withColumn("__f", F.lower(F.coalesce("firm", F.lit("")))).withColumn("__n", F.lower("name"))
    return global_rank(keyed, [F.asc("__f"), F.asc("__n"), F.asc("row_no"), F.asc("contact_id")], out).drop("__f", "__n")


def filter_lists(contacts: DataFrame, event_slots: DataFrame) -> DataFrame:
    """list_name, value: choices of each filter, (All) first."""
    spark = contacts.sparkSession
    firms = with_firm(named(contacts)).select(F.lit("firm").alias("list_name"), F.col("firm").alias("value")).distinct()
    events = event_slots.filter("short_name is not null").select(F.lit("event").alias("list_name"), F.col("short_name").alias("value")).distinct()
    fixed = [("met", v) for v in ("Yes", "No", "TBC")] + [("engagement", s) for s in STAGES] + [(k, ALL) for k in ("firm", "event", "met", "engagement")]
    return firms.unionByName(events).unionByName(spark.createDataFrame(fixed, "list_name string, value string"))
