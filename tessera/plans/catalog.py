"""Registered queries of the core. Each takes (spark, folder of the tables) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails, extract
from ..functions.names import candidates, name_tokens, with_split_name
from ..functions.text import person_key
from ..model import AS_OF, FIELDS
from ..operators import dashboard, derive, directory, formats, mail, meetings, quality, resolve
from ..session import new_path, table
from ..sources import readers, sheets
from .oracle import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["ORACLE", "QUERIES"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contacts")


@query
def q01_firm_rollup(spark, d):
    return dashboard.firm_rollup(_contacts(spark, d))


@query
def q02_kpis(spark, d):
    return dashboard.kpis(_contacts(spark, d), AS_OF)


@query
def q03_control_check(spark, d):
    return dashboard.control_check(_contacts(spark, d), table(spark, d, "firm_ref"))


@query
def q04_event_funnel(spark, d):
    return dashboard.event_funnel(_contacts(spark, d), table(spark, d, "event_slots"))


@query
def q04b_status_pivot(spark, d):
    return dashboard.status_pivot(_contacts(spark, d))


@query
def q05_engagement_mix(spark, d):
    return dashboard.engagement_mix(_contacts(spark, d))


@query
def q06_source_membership(spark, d):
    return dashboard.source_membership(_contacts(spark, d))


@query
def q07_derived(spark, d):
    out = derive.derived(_contacts(spark, d), table(spark, d, "event_slots"), AS_OF)
    return out.select("contact_id", "n_invited", "n_attended", "days_since", "engagement", F.col("overdue").cast("int").alias("overdue"))


@query
def q08_monthly_activity(spark, d):
    return meetings.monthly_activity(_contacts(spark, d), AS_OF)


@query
def q09_firm_coverage(spark, d):
    return meetings.firm_coverage(_contacts(spark, d), AS_OF)


@query
def q07b_rule_flags(spark, d):
    return derive.rule_flags(_contacts(spark, d), AS_OF)


@query
def q09b_all_firms(spark, d):
    firms = table(spark, d, "firm_ref").select(F.col("firm_name").alias("firm"))
    return meetings.firm_coverage(_contacts(spark, d), AS_OF, firms)


@query
def q10_followup_top15(spark, d):
    return meetings.follow_up(_contacts(spark, d), table(spark, d, "event_slots"), AS_OF)


@query
def q10b_followup_all(spark, d):
    return meetings.follow_up(_contacts(spark, d), table(spark, d, "event_slots"), AS_OF, None).select("place", "contact_id", "days_since")


@query
def q11_sort_rank(spark, d):
    return directory.numbered(derive.named(_contacts(spark, d)), "sort_place").select("contact_id", "sort_place")


@query
def q12_running_id(spark, d):
    from ..operators.ranking import global_rank

    return global_rank(derive.named(_contacts(spark, d)), [F.asc("row_no"), F.asc("contact_id")], "running_id").select("contact_id", "running_id")


@query
def q13_directory_filter(spark, d):
    rows = directory.passing(_contacts(spark, d), table(spark, d, "event_slots"), met="Yes", event="autumn", stage="event attendee", text="wealth")
    return directory.numbered(rows, "seq").select("seq", "contact_id", "name", "firm", "attended_events")


@query
def q14_attended_names(spark, d):
    rows = derive.named(_contacts(spark, d))
    return rows.select("contact_id", derive.attended_names(table(spark, d, "event_slots")).alias("attended_events")).filter("attended_events is not null")


def _sources(spark, d) -> DataFrame:
    return resolve.union_sources(sheets.meeting_list(table(spark, d, "meeting_list")), sheets.mass_email(table(spark, d, "mass_email")))


@query
def q15_entity_resolve(spark, d):
    return resolve.resolve(_sources(spark, d)).select("key", "firm", "name", "email", "met", "lastmtg", "mtgs", "invested", "mailsent", "e1", "e2", "e3", "notes", "source", "n_rows")


@query
def q15b_clusters(spark, d):
    return resolve.clusters(_sources(spark, d)).select("src_rank", "row_no", "key", "cluster_firm")


@query
def q16_fill_down(spark, d):
    rows = table(spark, d, "meeting_list").select("row_no", F.nullif("firm", F.lit("")).alias("firm"))
    return sheets.fill_down(rows, "firm", "row_no")


@query
def q17_meeting_sheet(spark, d):
    return sheets.meeting_list(table(spark, d, "meeting_list")).select("row_no", "name", "email", "firm", "met", "mtgs", "invested", "e1", "e2", "e3", "notes")


@query
def q17b_mail_sheet(spark, d):
    return sheets.mass_email(table(spark, d, "mass_email")).select("row_no", "name", "email", "firm", "mailsent", "met", "lastmtg", "mtgs", "notes")


def _ticks(spark, d) -> DataFrame:
    return _contacts(spark, d).filter("e2 in ('Attended', 'No Show')").select("name", "row_no", F.when(F.col("e2") == "Attended", "1").otherwise("0").alias("tick"))


@query
def q17c_ticked_sheet(spark, d):
    """The meeting list with an attendance sheet and firm aliases."""
    raw = sheets.join_aliases(table(spark, d, "meeting_list"), "firm", _aliases(spark, d))
    return sheets.meeting_list(raw, _ticks(spark, d)).select("row_no", "name", "firm", "e2", "notes")


def _aliases(spark, d) -> DataFrame:
    """Other names of firms: those of the list without their last word, where that is one firm's only."""
    short = table(spark, d, "firm_ref").select(F.regexp_replace("firm_name", r" \S+$", "").alias("alias"), F.col("firm_name").alias("canonical"))
    return short.groupBy(F.lower("alias").alias("alias")).agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other")).filter("canonical = other").drop("other")


def _asset_sheet(spark, d) -> DataFrame:
    """Contacts written down as the sheet of assets: an amount, else what is said about investing."""
    return _contacts(spark, d).select("name", "firm", F.coalesce(F.col("aum").cast("string"), F.nullif("invested", F.lit(""))).alias("aum_raw"), F.lit(7).alias("src_rank"), F.col("contact_id").alias("row_no"))


def _director_sheet(spark, d) -> DataFrame:
    """Contacts written down as the sheet of branches: the firm in every third row only."""
    c = _contacts(spark, d)
    one = lambda kind: F.when(F.col("ctype") == kind, F.col("name"))
    return c.select(
        F.when(F.col("contact_id") % 3 == 0, F.col("firm")).alias("firm"), F.col("source").alias("branch"), one("Branch Director").alias("director"), one("Consultant").alias("consultant"), F.col("linkedin").alias("li_contacted"),
        F.col("notes").alias("note"), F.col("mailsent").alias("li_msg"), "email", F.col("met").alias("note2"), F.lit(8).alias("src_rank"), F.col("contact_id").alias("row_no"),
    )


@query
def q17d_asset_sheet(spark, d):
    return sheets.asset_list(_asset_sheet(spark, d)).select("row_no", "name", "firm", "aum", "notes")


@query
def q17e_director_sheet(spark, d):
    return sheets.branch_directors(_director_sheet(spark, d)).select("row_no", "name", "email", "firm", "ctype", "linkedin", "notes")


@query
def q15c_all_sheets(spark, d):
    """All four sheets in one list of persons."""
    four = resolve.union_sources(
        sheets.meeting_list(table(spark, d, "meeting_list")), sheets.mass_email(table(spark, d, "mass_email")), sheets.asset_list(_asset_sheet(spark, d)), sheets.branch_directors(_director_sheet(spark, d))
    )
    return resolve.resolve(four).select("key", "firm", "name", "email", "ctype", "met", "lastmtg", "mtgs", "invested", "aum", "mailsent", "linkedin", "e1", "e2", "e3", "notes", "source", "n_rows")


@query
def q18_tidy(spark, d):
    return resolve.tidied(_contacts(spark, d)).select("contact_id", "met", "mtgs", "invested", "mailsent")


@query
def q19_attendance_lookup(spark, d):
    """Ticks of the second event by name, the last row of a name winning, looked up for the meeting list."""
    seen = _ticks(spark, d)
    rows = table(spark, d, "meeting_list").select("row_no", person_key(F.col("name")).alias("key")).filter("key is not null")
    return rows.join(sheets.attendance_flags(seen), "key", "left").select("row_no", "key", F.when(F.col("ticked"), "Attended").when(~F.col("ticked"), "No Show").otherwise("not listed").alias("status"))


@query
def q20_duplicate_names(spark, d):
    return quality.duplicate_names(_contacts(spark, d))


@query
def q21_profile_frequency(spark, d):
    return dashboard.profile(_contacts(spark, d))


@query
def q22_top10_firms(spark, d):
    return dashboard.top_firms(_contacts(spark, d))


@query
def q22b_ranked_firms(spark, d):
    return dashboard.ranked_firms(_contacts(spark, d))


@query
def q23_off_list(spark, d):
    return quality.off_list(_contacts(spark, d), "ctype", ("Adviser", "Branch Director", "Consultant", "Product / Platform", "Other"))


@query
def q24_minmax_scale(spark, d):
    return dashboard.scales(_contacts(spark, d))


@query
def q25_filter_lists(spark, d):
    return directory.filter_lists(_contacts(spark, d), table(spark, d, "event_slots"))


@query
def q26_raw_passthrough(spark, d):
    return quality.cleaned_sheet(table(spark, d, "meeting_list"))


@query
def q27_event_long(spark, d):
    return derive.long_events(derive.named(_contacts(spark, d)))


@query
def q28_add_contact(spark, d):
    rows, there = quality.added(_contacts(spark, d), "Nobody Newcomer", firm="Unknown")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("name") == "Nobody Newcomer").alias("n_new"), F.count_if((F.col("name") == "Nobody Newcomer") & (F.col("e5") == "Not Invited")).alias("n_default")).withColumn("was_there", F.lit(int(there)))


def _book(spark, d) -> DataFrame:
    return _contacts(spark, d).select(F.col("contact_id").alias("id"), "name", "email", "firm", "ctype")


@query
def q30_name_tokens(spark, d):
    return _contacts(spark, d).select("contact_id", F.array_join(name_tokens(F.col("name")), " ").alias("tokens"))


@query
def q31_split_name(spark, d):
    rows = with_split_name(_contacts(spark, d).select("contact_id", name_tokens(F.col("name")).alias("toks")))
    return rows.select("contact_id", F.array_join("given", " ").alias("given"), "sur")


@query
def q32_pattern_candidates(spark, d):
    rows = with_split_name(_contacts(spark, d).select("contact_id", name_tokens(F.col("name")).alias("toks")))
    return candidates(rows, "contact_id")


@query
def q33_domain_model(spark, d):
    m = formats.models(formats.learnable(_book(spark, d)))
    return m.select("domain", "pattern", F.round("confidence", 6).alias("confidence"), "samples", F.col("predictable").cast("int").alias("predictable"), F.coalesce(F.array_join("runners_up", ","), F.lit("")).alias("runners_up"), formats.verdict().alias("verdict"))


@query
def q34_suffix_style(spark, d):
    return formats.suffix_style(formats.learnable(_book(spark, d))).select("domain", F.round("suffix_rate", 6).alias("suffix_rate"))


@query
def q35_leave_one_out(spark, d):
    return formats.leave_one_out(formats.learnable(_book(spark, d)))


@query
def q36_firm_domain(spark, d):
    return formats.firm_domains(_book(spark, d))


@query
def q37_predict(spark, d):
    return formats.predictions(formats.guesses(_book(spark, d)))


@query
def q37b_placed_predictions(spark, d):
    return formats.placed_predictions(formats.predictions(formats.guesses(_book(spark, d)))).select("place", "id", "confidence_pct", "firm", "name")


@query
def q37c_predicted_domains(spark, d):
    return formats.predicted_domains(formats.predictions(formats.guesses(_book(spark, d))))


@query
def q38_needs_manual(spark, d):
    return formats.needs_manual(formats.guesses(_book(spark, d)))


@query
def q39_pooled_accuracy(spark, d):
    return formats.pooled(formats.leave_one_out(formats.learnable(_book(spark, d))))


@query
def q39b_format_report(spark, d):
    got = formats.report(formats.learnable(_book(spark, d)))
    return got.select("place", "domain", "samples", "pattern", F.round("confidence", 6).alias("confidence"), "correct", "accuracy", "verdict")


@query
def q40_extract_emails(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(extract.addresses(F.col("text"))).alias("email"), F.lit(False).alias("trusted"))
    found = found.withColumn("email", F.lower("email"))
    return extract.accepted(found).select("doc_id", "email").distinct()


@query
def q41_spelled_emails(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(extract.spelled_addresses(F.col("text"))).alias("email"), F.lit(False).alias("trusted"))
    return extract.accepted(found.withColumn("email", F.lower("email"))).select("doc_id", "email").distinct()


# Codes whose texts are known: key byte first, then each byte of the text with the key.
CODES = ("422f2b236c31362d2c270223212f276c36273136", "00696e666f40626f6c742e74657374", "FF9E9D9CBF9B9A99D18B9A8C8B", "7a", "zz00", "4a2", "", None)


@query
def q42_hex_decode(spark, d):
    """Fixed codes with known texts; bad ones give null."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "code_no int, code string")
    return rows.select("code_no", extract.decode_hex(F.col("code")).alias("email"))


@query
def q43_registrable_domain(spark, d):
    host = F.regexp_extract("source_url", "^[a-z]+://([^/]+)", 1)
    return table(spark, d, "hits").select("hit_id", emails.registrable(host).alias("site"))


@query
def q44_link_frontier(spark, d):
    """Links in documents, worth a visit first: own site of the firm concerned, no files."""
    rows = table(spark, d, "documents").select("doc_id", "domain", F.explode(extract.links(F.col("text"))).alias("url"))
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)
    rows = rows.filter(~path.rlike(extract.ASSET))
    return rows.select("doc_id", "url", extract.worth(path).cast("int").alias("worth"), F.coalesce(emails.registrable(host) == emails.registrable(F.col("domain")), F.lit(False)).cast("int").alias("own_site"))


@query
def q44b_frontier(spark, d):
    """Documents as pages: which links to visit next, by the page and site budgets."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), emails.registrable(F.col("domain")).alias("site"), F.posexplode(extract.links(F.col("text"))).alias("n", "url"))
    return extract.frontier(rows)


@query
def q45_classify(spark, d):
    out = mail.classified(table(spark, d, "hits").select("hit_id", "email"), table(spark, d, "domain_mx"))
    return out.select("hit_id", "email", F.col("syntax_ok").cast("int").alias("syntax_ok"), F.col("sendable").cast("int").alias("sendable"), "note")


@query
def q46_dedupe_hits(spark, d):
    return mail.kept_once(table(spark, d, "hits")).select("email", "hit_id", "nearby_name")


@query
def q46b_ordered_hits(spark, d):
    return mail.ordered_hits(table(spark, d, "hits")).select("place", "email", F.col("is_role").cast("int").alias("is_role"))


@query
def q47_import_set(spark, d):
    book = _book(spark, d)
    predicted = formats.predictions(formats.guesses(book)).withColumnRenamed("predicted_email", "email")
    crawled = mail.classified(mail.kept_once(table(spark, d, "hits").select("hit_id", "email", "nearby_name", "source_url")), table(spark, d, "domain_mx"))
    crawled = crawled.select(F.col("hit_id").alias("id"), F.col("nearby_name").alias("name"), "email", F.col("source_url").alias("found_on"), F.col("note").alias("status"))
    return mail.import_set(book, predicted, crawled)


@query
def q48_crawl_counters(spark, d):
    return mail.crawl_counters(table(spark, d, "hits"), "domain")


@query
def q48b_page_counters(spark, d):
    return mail.page_counters(table(spark, d, "hits"), "domain", ("/directory", "/branch"))


@query
def q49_page_hits(spark, d):
    """Pages put together from every hit and read again: a list item with a mail link, a cell with a coded address, or
    plain paragraphs, in turn."""
    def text(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    name, address, turn = text(F.coalesce("nearby_name", F.lit(""))), text(F.col("email")), F.col("hit_id") % 3
    html = (
        F.when(turn == 0, F.concat(F.lit("<ul><li>"), name, F.lit(' <a href="mailto:'), address, F.lit('?subject=x">write</a></li></ul>')))
        .when((turn == 1) & F.col("email").rlike(r"^[\x20-\x7e]+$"), F.concat(F.lit("<table><tr><td>"), name, F.lit(' <span data-cfemail="'), extract.encode_hex(F.col("email"), 0x2A), F.lit('">[protected]</span></td></tr></table>')))
        .otherwise(F.concat(F.lit("<p>"), name, F.lit("</p><p>Write to "), address, F.lit(" today</p>")))
    )
    return extract.page_hits(table(spark, d, "hits").select(F.col("hit_id").alias("page_id"), F.col("source_url").alias("url"), html.alias("html"))).drop("url")


@query
def q50_events_filled(spark, d):
    """Contacts by number of events attended."""
    rows = derive.named(_contacts(spark, d)).select(derive.n_attended().alias("n_attended"))
    return rows.groupBy("n_attended").agg(F.count("*").alias("contacts"))




@query
def q54_json_round_trip(spark, d):
    """Contacts written as JSON and read again; empty texts come back as null."""
    at = new_path(spark, "json")
    readers.write_json(_contacts(spark, d).select(*FIELDS), at)
    return readers.read_contacts_json(spark, at, lines=True)


@query
def q55_csv_round_trip(spark, d):
    """The raw meeting list written as CSV and read again by name, one column more and in another order."""
    at, columns = new_path(spark, "csv"), ["row_no", "name", "email", "firm", "met", "invested"]
    readers.write_csv(table(spark, d, "meeting_list").withColumn("row_no", F.col("row_no").cast("string")), at, [*columns[::-1], "extra"])
    return readers.read_csv(spark, at, columns)


@query
def q56_address_book(spark, d):
    return readers.read_address_book(_contacts(spark, d))
