"""Schemas and value lists. Dictionaries are parameters; these are defaults."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T

# Status names of events, stages and choices.
NOT_INVITED = "Not Invited"
STATUSES = ("Attended", "No Show", "Accepted", "Invited", "No Reply", "Declined", NOT_INVITED)
STAGES = ("Event attendee", "Met (no event)", "Invited only", "Contacted only", "Not yet contacted")
EVENTS = ("e1", "e2", "e3", "e4", "e5")
ALL = "(All)"
UNKNOWN = "Unknown"
AS_OF = datetime.date(2026, 8, 15)

FIELDS = ("name", "email", "firm", "ctype", "source", "met", "lastmtg", "mtgs", "invested", "aum", "mailsent", "linkedin", *EVENTS, "notes")
CONTACT = T.StructType(
    [T.StructField(f, {"lastmtg": T.DateType(), "mtgs": T.IntegerType(), "aum": T.DoubleType()}.get(f, T.StringType())) for f in FIELDS]
)
HIT = T.StructType([T.StructField(f, T.BooleanType() if f == "is_role" else T.StringType()) for f in ("email", "domain", "source_url", "nearby_name", "is_role")])

# Firms that are one and the same, as a parameter of the reader; empty by default.
FIRM_ALIASES: dict[str, str] = {}
