"""Raw sheets brought to the contact record. Each row keeps src_rank and row_no, so order is data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import join_notes, person_key, recode, strip, without_placeholder
from ..model import CONTACT, FIRM_ALIASES, NOT_INVITED, UNKNOWN


SKIPPED = ("deg",)  # firm cells that are a slip


def first_match(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """A decision table: the value of the first rule that holds; a null condition does not hold."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


def firm(c: Column, aliases: dict[str, str] = FIRM_ALIASES) -> Column:
    """Canonical firm: the alias list by lower case, else the stripped text, Unknown if blank. Aliases
    are a literal map; a list that grows belongs in a table joined by ``join_aliases``."""
    text = strip(c)
    if aliases:
        pairs = [F.lit(x) for kv in aliases.items() for x in kv]
        text = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(text)), text)
    return F.coalesce(text, F.lit(UNKNOWN))


def join_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Canonical firm by a table (alias, canonical); Spark broadcasts it while it is small."""
    a = aliases.select(F.lower("alias").alias("__a"), "canonical").dropDuplicates(["__a"])
    out = df.withColumn("__t", strip(F.col(column))).join(a, F.lower("__t") == F.col("__a"), "left")
    return out.withColumn(column, F.coalesce("canonical", "__t", F.lit(UNKNOWN))).drop("__t", "__a", "canonical")


def record(df: DataFrame, **values: Column | str | None) -> DataFrame:
    """The contact fields plus src_rank and row_no; fields that are not given are null (events: Not Invited)."""
    def value(f) -> Column:
        v = values.get(f.name, NOT_INVITED if f.name in ("e1", "e2", "e3", "e4", "e5") else None)
        return (v if isinstance(v, Column) else F.lit(v)).cast(f.dataType).alias(f.name)

    return df.select(*[value(f) for f in CONTACT], F.col("src_rank").cast("int").alias("src_rank"), F.col("row_no").cast("int").alias("row_no"))


def named_rows(raw: DataFrame) -> DataFrame:
    """Rows with a name that are no total line, texts stripped."""
    rows = raw.select([strip(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes])
    return rows.filter("name is not null and not startswith(lower(name), 'total')")


def attendance_flags(attendance: DataFrame) -> DataFrame:
    """key, ticked: the last row of a name wins."""
    rows = attendance.select(person_key(F.col("name")).alias("key"), "row_no", (strip(F.col("tick").cast("string")) == "1").alias("t")).filter("key is not null")
    return rows.groupBy("key").agg(F.max_by(F.coalesce("t", F.lit(False)), "row_no").alias("ticked"))


def meeting_list(raw: DataFrame, attendance: DataFrame | None = None) -> DataFrame:
    """Raw columns name, email, firm, oct_event, met, last_meeting, invested, invited, accepted, invited_alt."""
    rows = named_rows(raw)
    if attendance is None:
        rows = rows.withColumn("ticked", F.lit(None).cast("boolean"))
    else:
        rows = rows.withColumn("key", person_key(F.col("name"))).join(attendance_flags(attendance), "key", "left").drop("key")
    acc, inv = F.col("accepted"), F.col("invited")
    e2 = first_match(
        [
            (F.col("ticked"), "Attended"), (~F.col("ticked"), "No Show"), (acc.isin("Declined", "Not Available"), "Declined"),
            (acc == "Bounced back", "No Reply"), ((inv == "1") | (F.col("invited_alt") == "1"), "No Reply"),
        ],
        NOT_INVITED,
    )
    rows = rows.withColumn("__e2", e2)
    e2 = first_match([((inv == "Macro Lunch") & (F.col("__e2") == "No Reply"), NOT_INVITED), (inv == "Overseas", "Declined"), (inv == "TBC", "Invited")], F.col("__e2"))
    free = F.col("ticked").isNull()
    notes = join_notes(
        "; ", F.when(free & (acc == "Not Available"), "not available"), F.when(free & (acc == "Bounced back"), "email bounced back"), F.when(inv == "Overseas", "Overseas")
    )
    met = recode(F.col("met"), {"yes": "Yes"})
    e1 = first_match([(F.col("oct_event") == "Yes", "Attended"), (F.col("oct_event") == "No", "No Reply"), (F.col("oct_event") == "Not Available", "Declined")], NOT_INVITED)
    return record(
        rows, name=F.col("name"), email=without_placeholder(F.col("email")), firm=firm(F.col("firm")), ctype="Adviser", source="Meeting List", met=met, lastmtg=F.col("last_meeting"),
        mtgs=F.when(met == "Yes", 1).otherwise(0), invested=recode(F.col("invested"), {"?": "TBC"}), e1=e1, e2=e2, e3=F.when(inv == "Macro Lunch", "Invited").otherwise(NOT_INVITED), notes=notes,
    )


def mass_email(raw: DataFrame) -> DataFrame:
    """Raw columns name, firm, email, sent, replied, meeting_date."""
    rows, held = named_rows(raw), F.col("meeting_date").isNotNull()
    return record(
        rows, name=F.col("name"), email=F.col("email"), firm=firm(F.col("firm")), ctype="Adviser", source="Mass Email", mailsent=F.when(F.coalesce(F.col("sent").startswith("Yes"), F.lit(False)), "Yes").otherwise("No"),
        met=F.when(held, "Yes"), lastmtg=F.col("meeting_date"), mtgs=F.when(held, 1).otherwise(0), notes=F.when(F.col("replied") == "Yes", "Replied to mass email"),
    )


def asset_list(raw: DataFrame) -> DataFrame:
    """Raw columns name, firm, aum_raw: a number is the amount, other text becomes a note."""
    rows = named_rows(raw)
    amount = F.col("aum_raw").try_cast("double")
    note = F.when(amount.isNull() & F.col("aum_raw").isNotNull(), F.concat(F.lit("AUM: "), F.col("aum_raw")))
    return record(rows, name=F.col("name"), firm=firm(F.col("firm")), ctype="Adviser", source="AUM Data", aum=amount, notes=note)


def fill_down(df: DataFrame, column: str, order: str, ignore: tuple[str, ...] = (), block: int = 1_000_000) -> DataFrame:
    """Carry the last value over blank rows. Values of ``ignore`` are neither carried nor kept.

    Rows are cut into blocks of ``order``; each is filled alone and its first blanks take the last value
    of the blocks before (one row per block), so no task holds the whole table."""
    value = F.when(~F.col(column).isin(*ignore), F.col(column)) if ignore else F.col(column)
    rows = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(order) / block))
    inside = W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    last = rows.groupBy("__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__last"))
    carried = last.select("__b", F.last("__last", ignorenulls=True).over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    out = rows.withColumn("__w", F.last("__v", ignorenulls=True).over(inside)).join(F.broadcast(carried), "__b", "left")
    return out.withColumn(column, F.coalesce("__w", "__before")).drop("__v", "__b", "__w", "__before")


def branch_directors(raw: DataFrame) -> DataFrame:
    """Raw columns firm (sparse), branch, director, consultant, li_contacted, note, li_msg, email, note2: up
    to two contacts per row."""
    rows = raw.select([strip(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes]).withColumn("__typed", strip(F.col("firm")))
    # such a row is skipped, and only after the carrying
    rows = fill_down(rows, "firm", "row_no", ignore=SKIPPED).filter(F.col("__typed").isNull() | ~F.col("__typed").isin(*SKIPPED)).drop("__typed")
    crm = F.coalesce(F.col("li_msg") == "already in CRM", F.lit(False))
    li = recode(F.col("li_contacted"), {"Can't find LinkedIn": "No LinkedIn found"})
    li = F.when((crm | F.coalesce(F.col("li_msg") == "Yes", F.lit(False))) & (F.coalesce(li, F.lit("No")) == "No"), "Yes").otherwise(li)
    branch = F.concat(F.lit("Branch: "), F.col("branch"))
    both = F.array_compact(
        F.array(
            F.when(F.col("director").isNotNull(), F.struct(F.col("director").alias("name"), F.col("email").alias("email"), F.lit("Branch Director").alias("ctype"), li.alias("linkedin"), join_notes(" | ", branch, F.col("note"), F.when(crm, "Already in CRM"), F.col("note2")).alias("notes"))),
            F.when(F.col("consultant").isNotNull(), F.struct(F.col("consultant").alias("name"), F.lit(None).cast("string").alias("email"), F.lit("Consultant").alias("ctype"), F.lit(None).cast("string").alias("linkedin"), join_notes(" | ", F.concat(F.lit("Reports to "), F.col("director")), branch).alias("notes"))),
        )
    )
    one = rows.select("firm", "src_rank", "row_no", F.inline(both))
    return record(one, name=F.col("name"), email=F.col("email"), firm=firm(F.col("firm")), ctype=F.col("ctype"), source="Branch Directors", linkedin=F.col("linkedin"), notes=F.col("notes"))
