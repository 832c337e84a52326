"""Checks and small changes of the contact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EVENTS, NOT_INVITED
from .derive import named


def duplicate_names(contacts: DataFrame) -> DataFrame:
    """contact_id, row_no, first_row of rows whose name (case and spaces aside) stands earlier. The first
    rows are aggregated map-side before the join, so a hot name moves as one row."""
    keyed = named(contacts).select("contact_id", "row_no", F.regexp_replace(F.lower("name"), r"\s", "").alias("k"))
    first = keyed.groupBy("k").agg(F.min("row_no").alias("first_row"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, "k").filter("row_no > first_row").select("contact_id", "row_no", "first_row")


def off_list(contacts: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """value, n of what is given but not in the list."""
    c = F.col(column)
    return contacts.filter(c.isNotNull() & (c != "") & ~c.isin(*values)).groupBy(c.alias("value")).agg(F.count("*").alias("n"))


def added(contacts: DataFrame, name: str, firm: str | None = None, email: str | None = None) -> tuple[DataFrame, bool]:
    """(contacts with one more row of defaults, whether the name was there already)."""
    key = name.lower().replace(" ", "")
    there = not named(contacts).filter(F.regexp_replace(F.lower("name"), r"\s", "") == key).isEmpty()
    row = {"name": name, "firm": firm, "email": email, "ctype": "Adviser", "source": "Other", "met": "No", "invested": "No", "mtgs": 0} | dict.fromkeys(EVENTS, NOT_INVITED)
    one = contacts.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in contacts.schema])
    return contacts.unionByName(one), there


def cleaned_sheet(raw: DataFrame) -> DataFrame:
    """A raw sheet as it is, error values (texts that start with #) as null."""
    return raw.select([F.when(~F.coalesce(F.col(c).startswith("#"), F.lit(False)), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes])
