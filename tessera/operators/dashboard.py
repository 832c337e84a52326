"""Headline figures, roll-ups and funnels; each is one pass with partial aggregation."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import safe_ratio
from ..model import STAGES, STATUSES, UNKNOWN
from .derive import engagement, long_events, n_attended, n_invited, named
from .ranking import global_rank, top


def with_firm(contacts: DataFrame) -> DataFrame:
    """Blank firms are the firm Unknown."""
    return contacts.withColumn("firm", F.coalesce(F.nullif(F.trim("firm"), F.lit("")), F.lit(UNKNOWN)))


def firm_rollup(contacts: DataFrame) -> DataFrame:
    """Ten measures per firm and a TOTAL row whose ratios are computed again, not summed. An empty
    table gives no row."""
    rows = with_firm(named(contacts)).select("firm", "met", "mtgs", "invested", "aum", n_invited().alias("i"), n_attended().alias("a"))
    out = rows.rollup("firm").agg(
        F.grouping("firm").alias("is_total"),
        F.count("*").alias("contacts"),
        F.count_if(F.col("met") == "Yes").alias("met"),
        F.coalesce(F.sum("mtgs"), F.lit(0)).alias("meetings"),
        F.count_if(F.col("i") > 0).alias("invited"),
        F.count_if(F.col("a") > 0).alias("attended"),
        F.count_if(F.col("invested") == "Yes").alias("investors"),
        F.round(F.coalesce(F.sum("aum"), F.lit(0.0)) / 1e6, 4).alias("aum_m"),
    )
    share = rows.agg(F.count("*")).scalar()  # one number, counted beside the roll-up; no task holds all firms
    return out.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("firm")).alias("firm"), F.col("is_total").cast("int").alias("is_total"), "contacts",
        F.round(safe_ratio(F.col("contacts"), share), 6).alias("share_of_db"), "met", F.round(safe_ratio(F.col("met"), F.col("contacts")), 6).alias("share_met"),
        "meetings", "invited", "attended", "investors", "aum_m",
    )


def kpis(contacts: DataFrame, as_of: datetime.date) -> DataFrame:
    """All tiles of the dashboard and the meeting page as name, value."""
    d = F.col("lastmtg")
    rows = named(contacts).select(F.lower(F.nullif(F.trim("firm"), F.lit(""))).alias("firm"), "met", "mtgs", "invested", "aum", "lastmtg", n_invited().alias("i"), n_attended().alias("a"), engagement().alias("stage"))
    one = rows.agg(
        F.count("*").alias("n"), F.countDistinct("firm").alias("firms"), F.count_if(F.col("met") == "Yes").alias("met"), F.coalesce(F.sum("mtgs"), F.lit(0)).alias("mtgs"),
        F.count_if(F.col("i") > 0).alias("inv"), F.count_if(F.col("a") > 0).alias("att"), F.count_if(d >= F.date_sub(F.lit(as_of), 90)).alias("d90"),
        F.count_if(d >= F.date_sub(F.lit(as_of), 30)).alias("d30"), F.count_if(F.datediff(F.lit(as_of), d) > 120).alias("late"), F.count_if(F.col("stage") == STAGES[4]).alias("never"),
        F.count_if(F.col("invested") == "Yes").alias("investors"), F.coalesce(F.sum("aum"), F.lit(0.0)).alias("aum"), F.min("lastmtg").alias("first"), F.max("lastmtg").alias("last"),
    )
    epoch = F.lit(datetime.date(1970, 1, 1))
    values = {
        "total_contacts": F.col("n"), "firms_covered": F.col("firms"), "contacts_met": F.col("met"), "meeting_coverage": safe_ratio(F.col("met"), F.col("n")),
        "total_meetings": F.col("mtgs"), "invited": F.col("inv"), "attended": F.col("att"), "attendance_rate": safe_ratio(F.col("att"), F.col("inv")),
        "met_last_90": F.col("d90"), "met_last_30": F.col("d30"), "overdue": F.col("late"), "never_contacted": F.col("never"), "investors": F.col("investors"),
        "aum_m": F.col("aum") / 1e6, "meetings_per_met": safe_ratio(F.col("mtgs"), F.col("met")),
        "first_meeting_day": F.datediff("first", epoch), "last_meeting_day": F.datediff("last", epoch),
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), F.round(v.cast("double"), 4).alias("value")) for k, v in values.items()])))


def control_check(contacts: DataFrame, firm_list: DataFrame) -> DataFrame:
    """Contacts whose firm is not in the list, as n_missing: 0 if the list is complete."""
    listed = firm_list.select(F.lower("firm_name").alias("k")).distinct()
    rows = with_firm(named(contacts)).select(F.lower("firm").alias("k"))
    return rows.join(listed, "k", "left_anti").agg(F.count("*").alias("n_missing"))


def event_funnel(contacts: DataFrame, event_slots: DataFrame) -> DataFrame:
    """Per slot (empty slots kept): counts by status and attended of invited (null where none)."""
    long = long_events(named(contacts)).filter(F.col("status").isin(*STATUSES[:-1]))
    s = F.col("status")
    got = long.groupBy("slot").agg(
        F.count("*").alias("invited"), F.count_if(s == "Attended").alias("attended"), F.count_if(s == "No Show").alias("no_show"), F.count_if(s == "Declined").alias("declined"),
        F.count_if(s == "No Reply").alias("no_reply"), F.count_if(s.isin("Invited", "Accepted")).alias("pending"),
    )
    free = F.concat(F.lit("(free slot "), F.col("slot").cast("string"), F.lit(")"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("invited", "attended", "no_show", "declined", "no_reply", "pending")]
    return event_slots.join(got, "slot", "left").select("slot", F.coalesce("full_name", free).alias("event"), "event_date", *zero, F.round(F.try_divide(F.col("attended"), F.col("invited")), 6).alias("rate"))


def status_pivot(contacts: DataFrame) -> DataFrame:
    """Statuses by slot as columns."""
    long = long_events(named(contacts)).select("slot", F.regexp_replace(F.lower("status"), " ", "_").alias("status"))
    return long.groupBy("slot").pivot("status", [s.lower().replace(" ", "_") for s in STATUSES]).count().na.fill(0)


def engagement_mix(contacts: DataFrame) -> DataFrame:
    """stage, contacts, share of every stage, stages without contacts too."""
    stages = contacts.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    got = named(contacts).select(engagement().alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))
    out = stages.join(got, "stage", "left")
    out = out.select("stage", F.coalesce("n", F.lit(0)).alias("contacts"))
    return out.withColumn("share", F.round(safe_ratio(F.col("contacts"), F.sum("contacts").over(W.partitionBy())), 6))


def source_membership(contacts: DataFrame) -> DataFrame:
    """source, contacts, share: a contact counts for each list it stands on, so shares exceed one together."""
    rows = named(contacts)
    parts = rows.select("contact_id", F.explode(F.array_distinct(F.transform(F.split("source", r"\+"), lambda p: F.trim(p)))).alias("source")).filter("source <> ''")
    got = parts.groupBy("source").agg(F.count("*").alias("contacts"))
    total = rows.agg(F.count("*").alias("n")).first()["n"]
    return got.withColumn("share", F.round(safe_ratio(F.col("contacts"), F.lit(total)), 6))


def profile(contacts: DataFrame) -> DataFrame:
    """column_name, value, n: frequency tables of the coded columns in one pass."""
    cols = ("firm", "met", "e1", "e2", "ctype", "source")
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in cols])
    return contacts.select(F.inline(values)).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def firm_counts(contacts: DataFrame) -> DataFrame:
    return with_firm(named(contacts)).groupBy("firm").agg(F.count("*").alias("contacts"))


def top_firms(contacts: DataFrame, k: int = 10) -> DataFrame:
    """The k firms with most contacts, name in order of code points on ties."""
    return top(firm_counts(contacts), [F.desc("contacts"), F.asc("firm")], k)


def ranked_firms(contacts: DataFrame) -> DataFrame:
    """All firms with their place in that order."""
    return global_rank(firm_counts(contacts), [F.desc("contacts"), F.asc("firm")], "place")


def scales(contacts: DataFrame) -> DataFrame:
    """firm, contacts, bar (share of the largest), colour (share met, 0 to 1)."""
    got = with_firm(named(contacts)).groupBy("firm").agg(F.count("*").alias("contacts"), F.count_if(F.col("met") == "Yes").alias("met"))
    most = got.agg(F.max("contacts")).scalar()  # one number
    return got.select("firm", "contacts", F.round(F.col("contacts") / most, 6).alias("bar"), F.round(safe_ratio(F.col("met"), F.col("contacts")), 6).alias("colour"))
