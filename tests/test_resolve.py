from __future__ import annotations

import random

from tessera.model import EVENTS, FIELDS, NOT_INVITED, UNKNOWN
from tessera.operators import resolve
from tessera.sources import sheets

SCHEMA = ", ".join(f"{f} {'date' if f == 'lastmtg' else 'int' if f == 'mtgs' else 'double' if f == 'aum' else 'string'}" for f in FIELDS) + ", src_rank int, row_no int"


def row(no, name, firm=UNKNOWN, **more):
    base = dict.fromkeys(FIELDS) | {"mtgs": 0} | dict.fromkeys(EVENTS, NOT_INVITED) | {"name": name, "firm": firm} | more
    return (*[base[f] for f in FIELDS], 1, no)


def fold(rows):
    """The sequential rule: the first slot of the key whose firm is Unknown or the same."""
    slots, out = {}, {}
    for r in sorted(rows, key=lambda r: r[-1]):
        d = dict(zip([*FIELDS, "s", "no"], r, strict=True))
        k = "".join(c for c in (d["name"] or "").lower() if "a" <= c <= "z") or f"row {10**12 + d['no']}"
        for slot in slots.setdefault(k, []):
            if slot["firm"] in (UNKNOWN, d["firm"]):
                break
        else:
            slot = {"firm": d["firm"], "email": None, "notes": ""}
            slots[k].append(slot)
        slot["email"] = slot["email"] or d["email"]
        if d["notes"] and d["notes"] not in slot["notes"]:
            slot["notes"] = f"{slot['notes']}; {d['notes']}" if slot["notes"] else d["notes"]
        out[d["no"]] = slot
    return {(k, s["firm"], s["email"], s["notes"] or None) for k, v in slots.items() for s in v}


def test_worked_rows(spark):
    rows = [
        row(1, "Ana Rivers", "Acme"), row(2, "ana  rivers", "Acme", email="ana@acme.test", mtgs=1), row(3, "Ana Rivers", "Birch"),
        row(4, "Ana Rivers"), row(5, "Ana Rivers", "Cedar"), row(6, "Ana Rivers", "Birch"),
    ]
    out = resolve.resolve(resolve.union_sources(spark.createDataFrame(rows, SCHEMA))).select("firm", "email", "mtgs", "n_rows").collect()
    assert sorted(map(tuple, out)) == [("Acme", "ana@acme.test", 1, 2), ("Birch", None, 0, 2), (UNKNOWN, None, 0, 2)]


def test_equals_sequential_fold_and_is_idempotent(spark):
    rng = random.Random(5)
    rows = [
        row(i, rng.choice(["Ana Rivers", "ANA rivers", "Bo Lee", "李", "", None]), rng.choice(["Acme", "Birch", "Cedar", UNKNOWN]), email=rng.choice([None, "", "a@x.test", "b@x.test"]), notes=rng.choice([None, "", "call", "call back", "met"]))
        for i in range(1, 121)
    ]
    got = resolve.resolve(resolve.union_sources(spark.createDataFrame(rows, SCHEMA)))
    seen = {(r.key, r.firm, r.email, r.notes) for r in got.collect()}
    want = {(k, f, e or None, n) for k, f, e, n in fold(rows)}
    assert seen == want
    again = got.withColumnRenamed("ord", "row_no0").selectExpr(*FIELDS, "1 src_rank", "cast(row_no0 % 1000000 as int) row_no")
    again = resolve.resolve(resolve.union_sources(again.filter("name <> ''")))
    assert again.count() == got.filter("name <> ''").count()


def test_fill_down_over_blocks(spark):
    rows = [(1, "Acme"), (2, None), (3, "deg"), (4, None), (5, "Birch"), (6, None)]
    df = spark.createDataFrame(rows, "row_no int, firm string")
    for block in (2, 100):
        out = sheets.fill_down(df, "firm", "row_no", ignore=("deg",), block=block).orderBy("row_no").collect()
        assert [r.firm for r in out] == ["Acme", "Acme", "Acme", "Acme", "Birch", "Birch"]


def test_event_rules(spark):
    cols = "name string, email string, firm string, oct_event string, met string, last_meeting date, invested string, invited string, accepted string, invited_alt string, src_rank int, row_no int"
    cases = [
        ("a", None, "Declined", None, "Attended", NOT_INVITED), ("b", None, "Declined", None, "No Show", NOT_INVITED), ("c", None, "Bounced back", None, "No Reply", NOT_INVITED), ("d", "1", None, None, "No Reply", NOT_INVITED),
        ("e", "Macro Lunch", None, "1", NOT_INVITED, "Invited"), ("a", "Macro Lunch", None, None, "Attended", "Invited"), ("a", "Overseas", None, None, "Declined", NOT_INVITED), ("f", "TBC", None, None, "Invited", NOT_INVITED),
    ]
    raw = spark.createDataFrame([(n, "n/a", None, None, "yes", None, "?", inv, acc, alt, 1, i) for i, (n, inv, acc, alt, _, _) in enumerate(cases)], cols)
    seen = spark.createDataFrame([("A", "1", 1), ("B", "1", 1), ("b", "0", 2)], "name string, tick string, row_no int")
    out = sheets.meeting_list(raw, seen).orderBy("row_no").collect()
    assert [(r.e2, r.e3) for r in out] == [(e2, e3) for *_, e2, e3 in cases]
    assert {(r.email, r.met, r.mtgs, r.invested, r.firm) for r in out} == {(None, "Yes", 1, "TBC", UNKNOWN)}


def test_other_sheets(spark):
    aum = spark.createDataFrame([("Ana", "Acme", "12.5", 2, 1), ("Bo", None, "pending", 2, 2), ("TOTAL", None, "99", 2, 3), (None, None, None, 2, 4)], "name string, firm string, aum_raw string, src_rank int, row_no int")
    assert [(r.name, r.aum, r.notes) for r in sheets.asset_list(aum).orderBy("row_no").collect()] == [("Ana", 12.5, None), ("Bo", None, "AUM: pending")]
    cols = "firm string, branch string, director string, consultant string, li_contacted string, note string, li_msg string, email string, note2 string, src_rank int, row_no int"
    rows = [("Acme", "North", "Ana", "Bo", "No", None, "already in CRM", "ana@acme.test", "x", 4, 1), (None, None, "Cy", None, "Can't find LinkedIn", None, None, None, None, 4, 2), ("deg", None, "Di", None, None, None, None, None, None, 4, 3), (None, None, None, None, None, None, None, None, None, 4, 4)]
    out = sheets.branch_directors(spark.createDataFrame(rows, cols)).orderBy("row_no", "name").collect()
    assert [(r.name, r.firm, r.ctype, r.linkedin, r.notes) for r in out] == [
        ("Ana", "Acme", "Branch Director", "Yes", "Branch: North | Already in CRM | x"), ("Bo", "Acme", "Consultant", None, "Reports to Ana | Branch: North"), ("Cy", "Acme", "Branch Director", "No LinkedIn found", None),
    ]


def test_aliases(spark):
    df = spark.createDataFrame([("acme ltd",), (" Acme Ltd ",), ("Birch",), ("",), (None,)], "firm string")
    want = ["Acme", "Acme", "Birch", UNKNOWN, UNKNOWN]
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(sheets.firm(F.col("firm"), {"acme ltd": "Acme"})).collect()] == want
    alias = spark.createDataFrame([("ACME LTD", "Acme")], "alias string, canonical string")
    assert sorted(r.firm for r in sheets.join_aliases(df, "firm", alias).collect()) == sorted(want)


def test_written_and_discarded(spark):
    import os

    from tessera.session import discard, written

    df = written(spark.range(5), "t")
    path = df._written_at.removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    discard(df, spark.range(1))
    assert not os.path.exists(path)
