from __future__ import annotations

import datetime
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.model import CONTACT, NOT_INVITED
from tessera.operators import dashboard, derive, directory, meetings, quality
from tessera.plans.catalog import ORACLE, QUERIES
from tessera.sources import readers
from tessera.streaming import refresh

AS_OF = datetime.date(2026, 8, 15)
COLS = "contact_id bigint, row_no int, name string, firm string, email string, notes string, source string, ctype string, met string, lastmtg date, mtgs int, invested string, aum double, mailsent string, linkedin string, e1 string, e2 string, e3 string, e4 string, e5 string"


@pytest.fixture
def three(spark):
    n = NOT_INVITED
    rows = [
        (1, 1, "a", "Acme", None, None, "L", "Adviser", "Yes", datetime.date(2026, 8, 1), 1, None, 2e6, None, None, "Attended", n, n, n, n),
        (2, 2, "b", "Acme", "b@acme.test", "50% off_1", "L + M", "x", "Yes", datetime.date(2026, 3, 1), 2, "Yes", None, None, None, "No Reply", "Declined", n, n, n),
        (3, 3, "c", "Birch", None, None, None, None, "No", None, 0, None, None, "Yes", None, n, n, n, n, n),
    ]
    return spark.createDataFrame(rows, COLS)


@pytest.fixture
def slots(spark):
    return spark.createDataFrame([(1, "Autumn Outlook", "Autumn", AS_OF), (2, None, None, None)], "slot int, full_name string, short_name string, event_date date")


def test_derived_and_rollup(three, slots):
    out = derive.derived(three, slots, AS_OF).orderBy("contact_id").collect()
    assert [(r.days_since, r.engagement, r.overdue, r.attended_events) for r in out] == [(14, "Event attendee", False, "Autumn"), (167, "Met (no event)", True, None), (None, "Contacted only", False, None)]
    roll = {r.firm: r for r in dashboard.firm_rollup(three).collect()}
    assert (roll["Acme"].contacts, roll["Acme"].share_of_db, roll["Acme"].met, roll["Acme"].meetings, roll["Acme"].invited, roll["Acme"].attended, roll["Acme"].aum_m) == (2, 0.666667, 2, 3, 2, 1, 2.0)
    assert (roll["TOTAL"].contacts, roll["TOTAL"].met, roll["TOTAL"].share_met) == (3, 2, 0.666667)
    assert sum(r.contacts for f, r in roll.items() if f != "TOTAL") == 3


def test_empty_table_and_funnel(three, slots):
    none = three.limit(0)
    assert dashboard.firm_rollup(none).count() == 0
    assert {r.kpi: r.value for r in dashboard.kpis(none, AS_OF).collect()}["meeting_coverage"] == 0
    got = {r.slot: r for r in dashboard.event_funnel(three, slots).collect()}
    assert (got[1].invited, got[1].attended, got[1].rate, got[2].event) == (2, 1, 0.5, "(free slot 2)")
    assert dashboard.event_funnel(none, slots).first().rate is None


def test_months_and_follow_up(three, slots):
    m = meetings.monthly_activity(three, AS_OF).orderBy("month").collect()
    assert (len(m), m[0].month, m[-1].month, m[-1].cumulative) == (18, datetime.date(2025, 3, 1), datetime.date(2026, 8, 1), 2)
    assert [r.name for r in meetings.follow_up(three, slots, AS_OF).orderBy("place").collect()] == ["b", "a"]


def test_directory(three, slots):
    def names(**kw):
        return sorted(r.name for r in directory.passing(three, slots, **kw).collect())

    assert names() == ["a", "b", "c"] and names(firm="ACME") == ["a", "b"] and names(event="AUT") == ["a"] and names(text="50% OFF_") == ["b"]
    assert names(text="a?me") == ["a", "b"] and names(text="b*ch") == ["c"] and names(met="yes", stage="met (no event)") == ["b"]
    assert sorted(r.place for r in directory.numbered(three.withColumn("firm", F.lit(None).cast("string")), "place").collect()) == [1, 2, 3]


def test_global_rank_is_a_permutation(spark):
    from tessera.operators.ranking import global_rank

    df = spark.range(5000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(7))).withColumn("hot", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("k")))
    out = global_rank(df, [F.asc("hot"), F.asc("id")], "place").orderBy("hot", "id").collect()
    assert [r.place for r in out] == list(range(1, 5001))


def test_quality(three):
    twice = three.unionByName(three.withColumn("contact_id", F.col("contact_id") + 10).withColumn("row_no", F.col("row_no") + 10).withColumn("name", F.concat(F.lit(" "), F.upper("name"))))
    assert sorted((r.contact_id, r.first_row) for r in quality.duplicate_names(twice).collect()) == [(11, 1), (12, 2), (13, 3)]
    more, there = quality.added(three, "A")
    assert there and more.count() == 4
    assert [r.value for r in quality.off_list(three, "ctype", ("Adviser",)).collect()] == ["x"]


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"name": "a", "email": "", "mtgs": 1, "aum": 2.5, "lastmtg": "2026-01-02"}]')
    r = readers.read_contacts_json(spark, str(tmp_path / "c.json")).first()
    assert (r.name, r.email, r.mtgs, r.aum, r.lastmtg) == ("a", None, 1, 2.5, datetime.date(2026, 1, 2)) and len(CONTACT) == len(r)
    readers.write_csv(spark.createDataFrame([("x, y", None)], "Name string, Email string"), str(tmp_path / "out"), ["Name", "Email", "Firm"])
    got = readers.read_csv(spark, str(tmp_path / "out"), ["Name", "Firm", "Why"]).first()
    assert (got.Name, got.Firm, got.Why) == ("x, y", None, None)
    assert readers.read_csv(spark, str(tmp_path / "missing"), ["A"]).count() == 0
    (tmp_path / "sites.txt").write_text("# sites\n\nhttps://acme.test\n  # no\nhttps://birch.test\n")
    assert readers.read_lines(spark, str(tmp_path / "sites.txt")).count() == 2
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Mia</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><v>3.5</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert readers.read_xlsx(tmp_path / "w.xlsx", "S", 2) == [[None, 3.5, "x"]]
    assert [tuple(r) for r in readers.read_sheet(spark, tmp_path / "w.xlsx", "S", ["a", "b", "c", "d"]).collect()] == [(None, "3.5", "x", None, 2)]


def test_writers(spark, three, tmp_path):
    rows = spark.createDataFrame([("a & <b>", 1.5, None, datetime.date(2026, 1, 2)), (" x\n", None, "", None)], "t string, n double, e string, d date")
    readers.write_workbook(tmp_path / "out.xlsx", {"One & two": rows, "None": rows.limit(0)})
    assert [tuple(r) for r in readers.read_sheet(spark, tmp_path / "out.xlsx", "One & two", ["t", "n", "e", "d"]).collect()] == [("a & <b>", "1.5", None, "2026-01-02", 2), (" x\n", None, "", None, 3)]
    assert readers.read_sheet(spark, tmp_path / "out.xlsx", "None", ["t"]).count() == 0
    readers.write_json(three, str(tmp_path / "j"))
    back = readers.read_contacts_json(spark, str(tmp_path / "j"), lines=True)
    assert sorted(r.name for r in back.collect()) == sorted(r.name for r in three.collect()) and back.count() == 3
    odd = spark.createDataFrame([(" a ", 'say "x", y'), ("", None)], "p string, q string")
    readers.write_csv(odd, str(tmp_path / "c"), ["q", "p", "z"])
    assert sorted(readers.read_csv(spark, str(tmp_path / "c"), ["p", "q", "z"]).collect(), key=str) == sorted([(" a ", 'say "x", y', None), (None, None, None)], key=str)
    book = readers.read_address_book(spark.createDataFrame([(" Mia ", "", None, "x", "y"), (" ", "a@b.c", "F", None, None)], "name string, email string, firm string, ctype string, source string")).collect()
    assert [tuple(r) for r in book] == [("Mia", None, None, "x", "y")]


def test_stream(spark, three, tmp_path):
    three.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(three.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.refreshed(stream, str(tmp_path / "store"), dashboard.firm_rollup, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert refresh.latest(spark, str(tmp_path / "out")).filter("is_total = 1").first().contacts == 3
    sums = {"contacts": "1", "met": "case when met = 'Yes' then 1 else 0 end"}
    for k in range(2):  # a second run of the stream finds nothing new and changes nothing
        refresh.accumulated(stream, ["firm"], sums, str(tmp_path / "sums"), str(tmp_path / "cp2")).awaitTermination()
        got = {r.firm: (r.contacts, r.met) for r in refresh.latest(spark, str(tmp_path / "sums")).collect()}
        want = {r.firm: (r.c, r.m) for r in three.groupBy("firm").agg(F.count("*").alias("c"), F.count_if(F.col("met") == "Yes").alias("m")).collect()}
        assert got == want
    three.withColumn("contact_id", F.col("contact_id") + 50).write.mode("append").parquet(str(tmp_path / "in"))
    refresh.accumulated(stream, ["firm"], sums, str(tmp_path / "sums"), str(tmp_path / "cp2")).awaitTermination()
    assert sum(r.contacts for r in refresh.latest(spark, str(tmp_path / "sums")).collect()) == 6


def test_fold_keeps_the_letter_of_every_character_that_has_one(spark):
    import sys
    import unicodedata

    from tessera.functions.text import fold

    chars = [c for c in map(chr, (i for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)) if unicodedata.category(c)[0] in "LN"]
    want = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars}
    chars = [c for c in chars if len(want[c]) <= 1 or want[c].isalpha() and unicodedata.category(c) in ("Lu", "Ll", "Lt")]
    df = spark.createDataFrame(pd.DataFrame({"c": chars}))
    got = {r.c: r.f for r in df.select("c", fold(F.col("c")).alias("f")).collect()}
    assert got == {c: want[c] for c in chars}
    assert spark.createDataFrame([("Nguyễn Thị Hồng\u00a0Phượng ﬁ Ｍｉａ",)], "c string").select(fold(F.col("c"))).first()[0] == "Nguyen Thi Hong Phuong fi Mia"


@pytest.mark.parametrize("name", ["q01_firm_rollup", "q04_event_funnel", "q11_sort_rank", "q15b_clusters", "q32_pattern_candidates", "q35_leave_one_out", "q45_classify", "q09b_all_firms", "q15c_all_sheets", "q17c_ticked_sheet", "q17e_director_sheet", "q39b_format_report", "q40_extract_emails", "q42_hex_decode", "q44b_frontier", "q49_page_hits"])
def test_queries_equal_sql(spark, name):
    import glob
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def flat(df):
        return sorted(tuple("-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) else str(v)[:19] for v in r) for r in df[cols].astype(object).itertuples(index=False))

    assert [tuple(x.removesuffix(" 00:00:00") for x in r) for r in flat(got)] == [tuple(x.removesuffix(" 00:00:00") for x in r) for r in flat(want)]


def test_every_query_is_registered_once_and_has_valid_sql():
    assert set(ORACLE) == set(QUERIES) and len(QUERIES) >= 69
