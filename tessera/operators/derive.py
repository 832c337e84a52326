"""Columns derived from one contact, all null-preserving."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EVENTS, NOT_INVITED, STAGES


def statuses() -> Column:
    return F.array(*[F.col(e) for e in EVENTS])


def n_invited() -> Column:
    """Statuses that are given and not Not Invited."""
    return F.size(F.filter(statuses(), lambda s: s.isNotNull() & ~s.isin("", NOT_INVITED))).cast("bigint")


def n_attended() -> Column:
    return F.size(F.filter(statuses(), lambda s: s == "Attended")).cast("bigint")


def days_since(as_of: datetime.date) -> Column:
    return F.datediff(F.lit(as_of), F.col("lastmtg"))


def engagement() -> Column:
    """Ordered stages: attended, met, invited, written to, none of these."""
    return (
        F.when(n_attended() > 0, STAGES[0])
        .when(F.col("met") == "Yes", STAGES[1])
        .when(n_invited() > 0, STAGES[2])
        .when((F.col("mailsent") == "Yes") | (F.col("linkedin") == "Yes"), STAGES[3])
        .otherwise(STAGES[4])
    )


def attended_names(event_slots: DataFrame) -> Column:
    """Short names of attended events in slot order. The slots are at most five by the schema; a slot
    without a name is left out."""
    named = {r.slot: r.short_name for r in event_slots.filter(f"slot between 1 and {len(EVENTS)}").select("slot", "short_name").distinct().collect()}
    return F.nullif(F.concat_ws(", ", *[F.when(F.col(e) == "Attended", F.lit(named.get(i))) for i, e in enumerate(EVENTS, 1)]), F.lit(""))


def named(contacts: DataFrame) -> DataFrame:
    """Rows that count as contacts: those with a name."""
    return contacts.filter("name is not null and trim(name) <> ''")


def derived(contacts: DataFrame, event_slots: DataFrame, as_of: datetime.date) -> DataFrame:
    """Contacts with n_invited, n_attended, attended_events, days_since, engagement, overdue."""
    return (
        named(contacts)
        .withColumn("n_invited", n_invited())
        .withColumn("n_attended", n_attended())
        .withColumn("attended_events", attended_names(event_slots))
        .withColumn("days_since", days_since(as_of))
        .withColumn("engagement", engagement())
        .withColumn("overdue", F.coalesce(F.col("days_since") > 120, F.lit(False)))
    )


def rule_flags(contacts: DataFrame, as_of: datetime.date, late: int = 120) -> DataFrame:
    """contact_id and what a sheet's rules mark: met, overdue, for each event good, warn, bad or dim, and whether a
    contact that was met has no meeting or a meeting no date (checks that should be 0)."""
    marks = {"Attended": "good", "No Show": "warn", "Declined": "bad", NOT_INVITED: "dim"}

    def mark(e: str) -> Column:
        out = F.lit(None).cast("string")
        for status, m in marks.items():
            out = F.when(F.col(e) == status, m).otherwise(out)
        return out.alias(f"{e}_mark")

    met, mtgs = F.coalesce(F.col("met") == "Yes", F.lit(False)), F.coalesce("mtgs", F.lit(0))
    return named(contacts).select(
        "contact_id", met.cast("int").alias("is_met"), F.coalesce(days_since(as_of) > late, F.lit(False)).cast("int").alias("is_late"), *[mark(e) for e in EVENTS],
        (met & (mtgs == 0)).cast("int").alias("met_without_meeting"), ((mtgs > 0) & F.col("lastmtg").isNull()).cast("int").alias("meeting_without_date"),
    )


def long_events(contacts: DataFrame) -> DataFrame:
    """contact_id, slot, status: one row per contact and event slot."""
    return contacts.select("contact_id", F.posexplode(statuses()).alias("slot", "status")).withColumn("slot", F.col("slot") + 1)
