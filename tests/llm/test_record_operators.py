"""Problems 2 to 7."""

from __future__ import annotations

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import mailboxes, people
from tessera.llm import p02_formatting_duplicates as p02
from tessera.llm import p03_name_variants as p03
from tessera.llm import p04_cross_source as p04
from tessera.llm import p05_incremental as p05
from tessera.llm import p06_reference_mapping as p06
from tessera.llm import p07_survivors as p07

CLASH = ["'x' as ek", "'x' as salt", "1 as rec", "'x' as person", "'x' as spelling", "array('x') as toks", "'x' as box", "'x' as batch", "'x' as key", "'x' as root"]


def contacts(spark, rows):
    cols = ["contact_id", "name", "email", "firm", "ctype", "source", "updated_at"]
    full = [tuple(list(r) + [None] * (len(cols) - len(r))) for r in rows]
    return spark.createDataFrame(full, "contact_id bigint, name string, email string, firm string, ctype string, source string, updated_at timestamp").selectExpr("*", *CLASH)


def hits(spark, rows):
    """hit_id, email, nearby_name, is_role, batch_no, source_url."""
    return spark.createDataFrame(rows, "hit_id bigint, email string, nearby_name string, is_role boolean, batch_no int, source_url string").selectExpr("*", *CLASH)


def test_copies(spark):
    rows = [
        (5, "Mia Stone", "mia.stone@acme.test"), (3, "stone, MIA", "<Mia.Stone@ACME.test>;"), (9, "Mia Stone", "mia.stone@acme.test"), (4, "Mía Stone", "mia.stone@acme.test"), (6, "Mia Stone", "mia.stone@"), (7, "Mia Stone", None),
        (8, "Mia Stone", "mia.stone@acme.test"), (1, None, "x@acme.test"), (2, None, "X@acme.test"), (10, "Mia Stone", "mia@stone@acme.test"), (11, "Al" * 50_000, "al@acme.test"),
    ]
    df = contacts(spark, rows)
    assert sorted(map(tuple, p02.copies_found(df).collect())) == [(1, 2), (3, 5), (3, 9)]
    got = {r.contact_id: r.copies for r in p02.records(df).collect()}
    assert got[3] == 3 and got[1] == 2 and sum(got.values()) == len(rows) and len(got) == len(rows) - 3
    assert p02.copies_found(df.limit(0)).count() == 0 and p02.records(df.limit(0)).count() == 0


def test_copies_equal_grouping_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Bo Lee", "lee bo", "Lee-Bo"]) if i % 3 == 0 else f"N{rng.randint(0, 300)} X", "hot@x.test" if i % 3 == 0 else f"n{rng.randint(0, 2)}@x.test") for i in range(1500)]
    want: dict = {}
    for i, n, e in rows:
        want.setdefault((e, tuple(sorted(n.lower().replace("-", " ").split()))), []).append(i)
    expect = sorted((min(v), x) for v in want.values() for x in v if x != min(v))
    assert sorted(map(tuple, p02.copies_found(contacts(spark, rows).repartition(5)).collect())) == expect


def test_filter_is_selective_and_loses_nothing(spark):
    df = spark.range(20000).select(F.xxhash64(F.when(F.col("id") < 200, F.col("id") % 100).otherwise(F.col("id"))).alias("__h"), "id").repartition(6)
    kept = {r.id for r in df.filter(p02.possible_repeats(df, 20000)).collect()}
    assert set(range(200)) <= kept and len(kept) < 1500


def test_filter_stays_selective_in_parts(spark, monkeypatch):
    """With a filter bound far below the rows, more parts keep it selective, and the records are the same."""
    rows = [(i, f"Name{i % 3900} X", f"n{i % 3900}@x.test") for i in range(4000)] + [(9000, None, None)]
    df = contacts(spark, rows)
    want = sorted(map(tuple, p02.copies_found(df).collect()))
    assert want == sorted((i, i + 3900) for i in range(100))
    monkeypatch.setattr(p02, "MAX_BITS", 1 << 13)
    maybe, single, groups = p02.divided(df)
    assert 200 <= maybe.count() < 500 and maybe.count() + single.count() == 4001
    assert sorted(map(tuple, p02.copies_found(df).collect())) == want
    got = {r.contact_id: r.copies for r in p02.records(df).collect()}
    assert len(got) == 3901 and got[5] == 2 and got[3800] == 1 and got[9000] == 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Mia.Stone@Acme.Test", "mia.stone@acme.test"), ("mailto:mia@acme.test?subject=x", "mia@acme.test"), ("%20mia@acme.test%20", "mia@acme.test"), ("mia [at] acme [dot] test", "mia@acme.test"), ("mia(at)acme.test", "mia@acme.test"), ("<mia+web@acme.test>;", "mia@acme.test"),
        ("mia @ acme.test.", "mia@acme.test"), ("(mia@acme.test", "mia@acme.test"), ("u003emiastone@acme.test", "miastone@acme.test"), ("m​ia@acme.test​", "mia@acme.test"), ("ｍｉａ@acme.test", "mia@acme.test"), ("nobody", None), ("a@b", None), ("", None), (None, None),
    ],
)
def test_mailbox(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "e string").select(mailboxes.mailbox(F.col("e"))).first()[0] == want


def _slip(rng, s):
    i, kind = rng.randrange(len(s)), rng.choice("diswn")
    if kind == "d":
        return s[:i] + s[i + 1 :]
    if kind == "i":
        return s[:i] + "z" + s[i:]
    if kind == "s":
        return s[:i] + "z" + s[i + 1 :]
    return s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :] if kind == "w" else s


def test_slips_always_share_a_node(spark):
    """The recall that the depths promise: every slip in a part, short parts too."""
    rng = random.Random(4)
    pairs = []
    for k in range(1200):
        local = "".join(rng.choices("abcdefgh.", k=rng.randint(2, 19))).strip(".") or "abcd"
        domain = "".join(rng.choices("klmnop", k=rng.randint(1, 14))) + ".test"
        pairs.append((k, f"{local}@{domain}", f"{_slip(rng, local) or 'a'}@{_slip(rng, domain)}"))
    df = spark.createDataFrame(pairs, "id int, a string, b string").filter("split(b, '@')[1] <> ''")
    a, b = F.col("a"), F.col("b")
    ok = mailboxes.within_one_edit(mailboxes.local_of(a), mailboxes.local_of(b)) & mailboxes.within_one_edit(mailboxes.domain_of(a), mailboxes.domain_of(b))
    df = df.filter(ok)
    assert df.count() > 1150
    for widened, asked in ((mailboxes.ANY_SLIP, df), (mailboxes.SAME_DOMAIN, df.filter(mailboxes.domain_of(a) == mailboxes.domain_of(b))), (mailboxes.EXACT, df.filter("a = b"))):
        mine = mailboxes.with_keys(asked.select("id", a.alias("box")), widened != mailboxes.EXACT, widened)
        theirs = mailboxes.with_keys(asked.select("id", b.alias("box")), False, widened)
        assert mine.join(theirs, ["id", "key"]).select("id").distinct().count() == asked.count()


def _arriving():
    url = "https://acme.test/x"
    return [
        (10, "MIA.STONE@acme.test;", None, False, 1, url), (11, "mia.stnoe@acme.test", None, False, 1, url), (12, "new.one@acme.test", None, False, 1, url), (13, "new.one@acme.test", None, False, 1, url), (14, "new.one+x@acme.test", None, False, 2, url),
        (15, "half@acme.test", None, False, 2, url), (16, None, None, None, 3, None), (17, "junk", None, False, 3, url), (18, "new.oe@acmee.test", None, False, None, url), (19, "i.stone@acme.test", None, False, 3, url), (20, "k.stone@acme.test", None, False, 4, url), (14, "new.one+x@acme.test", None, False, 2, url),
        (21, "jobs@acme.test", None, True, 1, url), (22, "job@acme.test", None, True, 2, url), (23, "hr@acme.test", None, True, 2, url), (24, "pr@acme.test", None, True, 3, url), (25, "x" * 20_000 + "@acme.test", None, True, 3, url),
    ]


def test_batches(spark):
    c = contacts(spark, [(1, "a", "mia.stone@acme.test"), (2, "b", "half@"), (3, "c", None)])
    h = hits(spark, _arriving())
    want = [10, 11, 14, 14, 18, 22]
    assert sorted(r.hit_id for r in p05.hits_found(c, h).collect()) == want
    assert sorted(r.hit_id for r in p05.hits_by_batch(c, h).collect()) == want
    assert p05.hits_found(c, h.limit(0)).count() == 0 and p05.hits_by_batch(c, h.limit(0)).count() == 0
    assert sorted(r.hit_id for r in p05.hits_found(c.limit(0), h).collect()) == [14, 14, 18, 22]


def test_batches_equal_brute_force(spark):
    rng = random.Random(8)
    names = [f"{rng.choice(['ann', 'bea', 'carl', 'dora'])}.{''.join(rng.choices('abcdefgh', k=6))}@{rng.choice(['acme', 'bolt', 'corvane'])}.test" for _ in range(60)]
    rows = [(i, (lambda n: n if rng.random() < 0.6 else _slip(rng, n.split("@")[0]) + "@" + n.split("@")[1])(rng.choice(names)), None, False, rng.randint(1, 5), None) for i in range(500)]
    h = hits(spark, rows)
    boxes = h.select("hit_id", "batch_no", mailboxes.mailbox(F.col("email")).alias("box"))
    other = boxes.select(F.col("batch_no").alias("since"), F.col("box").alias("held")).distinct()
    want = boxes.join(other, F.col("since") < F.col("batch_no")).filter(mailboxes.same_but_slip(F.col("box"), F.col("held"))).select("hit_id").distinct()
    want = sorted(r.hit_id for r in want.collect())
    none = contacts(spark, [])
    assert sorted(r.hit_id for r in p05.hits_found(none, h).collect()) == want == sorted(r.hit_id for r in p05.hits_by_batch(none, h).collect())


def _boxes(spark, names, batch):
    return spark.createDataFrame([(n, batch) for n in names], "box string, batch int")


def test_a_forest_is_opened_again_and_merged(spark):
    forest = p05.HashForest(spark)
    for k in range(5):
        forest.check(_boxes(spark, [f"person{k}x@acme.test", f"other{k}@bolt{k}.test"], k))
    assert [r["level"] for r in forest.runs] == [1, 0] and forest.rows() == 10 * 8  # four batches merged, one new
    again = p05.HashForest(spark, forest.path)
    assert again.runs == forest.runs and again.version == forest.version
    asked = _boxes(spark, ["persn2x@acme.test", "other3@bolt3.test", "nobody@acme.test"], 50)
    before = sorted(r.box for m in again.check(asked) for r in m.collect())
    again.merge()
    assert before == ["other3@bolt3.test", "persn2x@acme.test"] and len(again.runs) == 1 and again.rows() == 12 * 8
    assert sorted(r.box for m in p05.HashForest(spark, forest.path).check(_boxes(spark, ["persn2x@acme.test", "other3@bolt3.test"], 51)) for r in m.collect()) == before
    again.drop()


def test_a_batch_reads_only_what_it_touches(spark):
    """What a batch of one domain reads does not grow with the history of other domains."""
    read = []
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 10):
            spark.conf.set("spark.sql.shuffle.partitions", str(48 * n))
            forest = p05.HashForest(spark)
            rng = random.Random(3)
            word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=9))
            domains = ["corvanehill.test"] + [word() + ".test" for _ in range(40 * n)]
            forest.append(_boxes(spark, ["jonasweber@corvanehill.test"] + [f"{word()}@{d}" for d in domains for _ in range(5)], 0))
            files = forest.touched(_boxes(spark, ["jonaswebr@corvanehill.test"], 1), mailboxes.ANY_SLIP)
            read.append(sum(f[3] for _, f in files))
            assert [r.box for m in forest.check(_boxes(spark, ["jonaswebr@corvanehill.test"], 1)) for r in m.collect()] == ["jonaswebr@corvanehill.test"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert read[1] <= 1.5 * read[0] and read[1] < forest.rows() / 4


def test_tree_returns_every_entry_within_the_threshold():
    rng = random.Random(6)
    keys = {"".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(300)}
    tree = p06.BKTree()
    for k in keys:
        tree.add(k)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(60):
        q = "".join(rng.choices("abcd", k=rng.randint(0, 8)))
        assert tree.within(q, 2) == sorted((d, k) for k in keys if (d := plain(q, k)) <= 2)
        for k in list(keys)[:40]:
            assert p06.levenshtein(q, k) == plain(q, k)


REFERENCE = [(1, "Alder Wealth Partners"), (2, "Alder Insurance Brokers"), (3, "Brackmoor Asset Management"), (4, "Zenith Life & Pensions")]


def test_firms(spark):
    cases = {
        "Alder Wealth Partners": None, None: None, "": None, "Unknown": None, " ": None, "ALDER WLTH PRTNRS (S) PTE LTD": 1, "Aldr Wealth Partners": 1, "Wealth Partners, Alder": 1, "Alder Ins. Brkrs": 2, "Brackmoor": 3, "B.A.M.": 3, "BAM Pte Ltd": 3,
        "Brackmoor Asset Mgmt - Westmead": 3, "Alder": -1, "Alder Pohek Logistics": -1, "Alder Ltd": -1, "own practice": -1, "?": -1, "Zenith Life and Pensions": 4, "ZLAP": 4, "BrackmoorAssetManagement": 3, "x" * 100_000: -1,
    }
    df = contacts(spark, [(i, "n", None, f) for i, f in enumerate(cases)] * 2)
    ref = spark.createDataFrame(REFERENCE, "firm_id bigint, firm_name string").selectExpr("*", "1 as contact_id")
    got = p06.firms_found(df, ref).collect()
    want = {i: w for i, w in enumerate(cases.values()) if w is not None}
    assert {r.contact_id: r.firm_id for r in got} == want and len(got) == 2 * len(want)
    assert {r.firm_id for r in p06.firms_found(df, ref.limit(0)).collect()} == {-1} and p06.firms_found(df.limit(0), ref).count() == 0


def test_firms_in_shards_are_the_same(spark, monkeypatch):
    """Forms and vocabulary come from the whole list, whatever the shards; entries share beginnings, names and initials."""
    entries = [*REFERENCE, (5, "Alder Capital"), (6, "Aldea Life"), (7, "Acme"), (8, "Acme Wealth"), (9, "Twin Firm"), (10, "Twin Firm"), (0, "Zero Partners")]
    cases = {
        "Brackmore Asset Management": 3, "Alder Wlth Ptnrs": 1, "nothing": -1, "Zenith Lif & Pensions": 4, "Alder Ltd": -1, "Aldea Ltd": 6, "ACME Pte Ltd": 7, "Acme Wlth": 8, "twin firm": -1, "TWIN FIRM LLP": -1, "Zero Prtnrs": 0, "Acme, Wealth": -1,
        "BAM": 3, "ZLP": 4, "": -1, "Aldr Wealth Partners": 1, "x" * 3000: -1,
    }
    df = contacts(spark, [(i, "n", None, f) for i, f in enumerate([*cases, None])]).select("contact_id", "firm")
    ref = spark.createDataFrame(entries, "firm_id bigint, firm_name string")
    want = [*enumerate(cases.values()), (len(cases), None)]
    for n in (1 << 30, 3):
        monkeypatch.setattr(p06, "MAX_ENTRIES", n)
        got = p06.find_entry(df, "firm", ref, "firm_id", "firm_name", "found").select("contact_id", "found").collect()
        assert sorted(map(tuple, got)) == want
    assert {r.found for r in p06.find_entry(df, "firm", ref, "firm_id", "firm_name", "found").limit(0).collect()} == set()


def test_survivors(spark):
    t = lambda d: datetime.datetime(2025, 1, d)
    rows = [
        (1, "a", "a@x.test", None, "Adviser", "Low", t(1)), (2, "a", "A@x.test;", None, "TBC", "High + Low", t(2)), (3, "a", "half@", None, "Consultant", "High", None), (4, "a", None, None, "Adviser", "??", t(9)), (5, "b", None, None, None, None, None),
        (6, "c", "c@x.test", None, "Adviser", "Low", None), (7, "c", "c2@x.test", None, "Consultant", "Low", None), (8, "c", "c3@x.test", None, None, "Low+High", None),
    ]
    groups = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 2), (2, 5), (3, 6), (3, 7), (3, 8), (4, 99)], "group_id bigint, contact_id bigint").selectExpr("*", "'x' as source", "'x' as email")
    trust = spark.createDataFrame([("High", 8), ("Low", 1)], "source string, trust int")
    got = {(r.group_id, r.field_name): r.contact_id for r in p07.survivors(contacts(spark, rows), groups, trust).collect()}
    assert got == {(1, "email"): 2, (1, "ctype"): 3, (1, "source"): 2, (3, "email"): 8, (3, "ctype"): 6, (3, "source"): 8}
    assert p07.survivors(contacts(spark, rows).limit(0), groups, trust).count() == 0 and p07.survivors(contacts(spark, rows), groups.limit(0), trust).count() == 0


def test_currency_decides_among_undated_rows(spark):
    t = lambda d: datetime.datetime(2025, 1, d)
    rows = [(10 * g + k, "a", None, None, c, "Low", t(k + 1)) for g in range(3) for k, c in enumerate(["Consultant", "Adviser"])]
    rows += [(100, "b", None, None, "Consultant", "Low", None), (101, "b", None, None, "Adviser", "Low", None)]
    groups = spark.createDataFrame([(g, 10 * g + k) for g in range(3) for k in range(2)] + [(9, 100), (9, 101)], "group_id bigint, contact_id bigint")
    trust = spark.createDataFrame([("Low", 1)], "source string, trust int")
    ids = [{r.group_id: r.contact_id for r in p07.survivors(contacts(spark, rows), groups, trust, c).filter("field_name = 'ctype'").collect()}[9] for c in (False, True)]
    assert ids == [100, 101]  # smallest id; the value that is known to follow


def test_currency_is_transitive_and_cycles_are_ties(spark):
    def pairs(*p):
        return spark.createDataFrame([("ctype", a, b) for a, b in p], "field_name string, value string, later string")

    got = {(r.value, r.later) for r in p07.closure(pairs(("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "a"))).collect()}
    assert got == {(p, q) for p, q in itertools.combinations("abcd", 2)} | {(p, q) for p in "xyz" for q in "abcd"}
    assert p07.closure(pairs().limit(0)).count() == 0
    t = lambda d: datetime.datetime(2025, 1, d)
    steps = [("Consultant", "Branch Director"), ("Branch Director", "Adviser")]  # Consultant never stands beside Adviser with dates
    rows = [(10 * g + k, "a", None, None, c, "Low", t(k + 1)) for g, s in enumerate(steps * 2) for k, c in enumerate(s)]
    rows += [(100, "b", None, None, "Consultant", "Low", None), (101, "b", None, None, "Adviser", "Low", None)]
    groups = spark.createDataFrame([(g, 10 * g + k) for g in range(4) for k in range(2)] + [(9, 100), (9, 101)], "group_id bigint, contact_id bigint")
    trust = spark.createDataFrame([("Low", 1)], "source string, trust int")
    got = {(r.group_id, r.field_name): r.contact_id for r in p07.survivors(contacts(spark, rows), groups, trust, True).collect()}
    assert got[9, "ctype"] == 101


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Mia Stone", "stone, MIA", 2), ("Mia Lux Stone", "Mia Stone", 2), ("M. Stone", "Mia Stone", 1), ("Mia Stone", "Mia Stnoe", 2), ("Mia L. Stone", "Mia Lux Stone", 2), ("Mia Stone", "Ivo Stone", 0), ("Theo P. Rikugak", "Theo Pomafahel", 0),
        ("Mia Lux Stone", "Mia Orr Stone", 0), ("Mia", "Mia Stone", 0), ("Robt Stone", "Bob Stone", 0), ("Dr Robert Stone", "Bob Stone", 2), ("Mia O'Stone", "Mia OStone (Mimi)", 2),
    ],
)
def test_alignment(a, b, same):
    full = {"bob": "robert", "mimi": "mia"}
    assert people.align(people.parse_name(a, full)[1], people.parse_name(b, full)[1])[1] == same


def test_assignment_is_optimal_at_every_length():
    rng = random.Random(12)
    words = ["mia", "mi", "m", "stone", "stoen", "ston", "stones", "lux", "luxor", "l", "anna", "ann", "annabel", "robert", "robret", "r"]

    def brute(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        best = -1.0
        for at in itertools.permutations(range(len(b)), len(a)):
            got = [0.0 if len(b[j]) == 1 < len(x) and len(a) < len(b) else people.similar(x, b[j]) for x, j in zip(a, at)]
            if all(got):
                best = max(best, sum(got))
        return best

    for _ in range(300):
        a, b = rng.sample(words, rng.randint(2, 5)), rng.sample(words, rng.randint(2, 6))
        want = brute(a, b)
        assert people.align(a, b)[0] == pytest.approx(max(want, 0.0)), (a, b)
    # more words than a usual name has: one slip still aligns, another word does not
    long = [f"{w}word" for w in "abcdefghijklmnopqrstuvwxyz"]
    assert people.align(long, [*long[:-1], "zwrod"])[1] == 26 and people.align(long[:9], ["awordd", *long[1:9]])[1] == 9
    assert people.align(long, [*long[:-1], "other"])[1] == 0
    assert people.align([f"w{i}x" for i in range(1500)], [f"w{i}x" for i in range(1499, -1, -1)])[1] == 1500


@pytest.mark.parametrize(("a", "b", "want"), [("anna", "anan", 0.9), ("anna", "annas", 0.9), ("stone", "stoone", 0.9), ("stone", "stane", 0.9), ("ben", "benjamin", 0.7), ("tan", "ton", 0.0), ("stone", "stnoee", 0.0), ("m", "mia", 0.5), ("m", "m", 0.5), ("mia", "mia", 1.0)])
def test_similar_words(a, b, want):
    assert people.similar(a, b) == people.similar(b, a) == want


SHORT = [("Robert", "Bob")]


def tables(spark, c, h):
    return contacts(spark, c), hits(spark, h), spark.createDataFrame(REFERENCE, "firm_id bigint, firm_name string"), spark.createDataFrame(SHORT, "given string, short_form string")


def test_persons(spark, monkeypatch):
    c = [
        (1, "Robert Kivefirol", "robert.kivefirol@alderwp.test", "Alder Wealth Partners"), (2, "Bob Kivefirol", None, "Alder Wlth Partners"), (3, "KIVEFIROL, R.", None, "Alder Wealth Partners"), (4, "Robert Kivefirol", None, "Brackmoor"), (5, "robert  kivefirol", "ROBERT.KIVEFIROL@alderwp.test", "own practice"),
        (6, None, None, "Alder Wealth Partners"), (7, "Samuel Ruhegaji", None, "Brackmoor"), (8, "Sebastian Ruhegaji", None, "Brackmoor"), (9, "S. Ruhegaji", None, "Brackmoor"), (10, "x" * 20_000, None, None), (2, "Bob Kivefirol", None, "Alder Wlth Partners"),
        (11, " ".join(f"w{i}ord" for i in range(40)), None, "Brackmoor"), (12, " ".join(f"w{i}ord" for i in range(41)), None, "Brackmoor"),
    ]
    u = "https://www.alderwp.test/team"
    h = [
        (100, "robert.kivefirol@alderwp.test", "Robert Kivefirol", False, 1, u), (101, "robert.kivefrol@alderwp.test", "Rоbert Kivefirol", False, 2, u), (102, "kivefirolr1x9@mail.test", "R. Kivefirol", False, 2, u), (103, "info@alderwp.test", "Robert Kivefirol", True, 1, u),
        (104, "robert.kivefirol@alderwp.test", "Our Team", False, 3, u), (105, None, None, None, None, None), (106, "kivefirolr1x9@mail.test", None, False, 5, u),
    ]
    t = tables(spark, c, h)
    got = {tuple(r) for r in p03.found(*t).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5), (11, 12), (100, 102), (101, 102)}
    kept = {(r.src, r.row_id): r.person for r in p03.members(*t).collect()}
    assert len({kept["contacts", i] for i in (1, 2, 3, 5)}) == 1 and kept["contacts", 4] != kept["contacts", 1] and ("hits", 106) not in kept
    monkeypatch.setattr(p03, "ROWS", 2)
    assert {tuple(r) for r in p03.found(*t).collect()} == got
    rows = p04.matched_rows(*t).collect()
    assert {tuple(r)[:2] for r in rows} == {(i, j) for i in (1, 2, 3, 5) for j in (100, 101, 102, 104, 106)}
    assert all(0 < r.confidence <= 1 for r in rows)


def test_cross_source_names_without_address(spark):
    firm, u = "Alder Wealth Partners", "https://www.alderwp.test/team"
    c = [(1, "G. Lajonipo", None, firm), (2, "Edward Lagobohes", None, firm), (3, "S. Ruhegaji", None, firm), (4, "B. Dutanozen", None, firm)]
    c += [(10 + i, f"{n} Xa{w}", f"{n}.xa{w}@alderwp.test".lower(), firm) for i, (n, w) in enumerate((n, w) for n in ("Edward", "Gabriel", "Samuel") for w in ("bopilat", "cudenor", "fegasum", "ritovak"))]
    h = [
        (100, "kolibri91@mail.test", "Gabriel Lajonipo", False, 1, u), (101, "wanderer42@mail.test", "Edward Lahobohes", False, 1, u), (102, "teapot63@mail.test", "Samuel Ruhegaji", False, 1, u), (103, "mountain58@mail.test", "Sebastian Ruhegaji", False, 1, u),
        (104, "bdutanozen@alderwp.test", None, False, 1, u),
    ]
    h += [(200 + r[0], r[2], r[1], False, 1, u) for r in c[4:]]
    got = {tuple(r)[:2] for r in p04.matched_rows(*tables(spark, c, h)).collect()}
    # an initial and a unique surname, a slip in the surname, an address made from an initial; S. could be two
    assert got == {(1, 100), (2, 101), (4, 104)} | {(r[0], 200 + r[0]) for r in c[4:]}


def test_persons_of_empty_tables(spark):
    c, h, ref, short = tables(spark, [], [])
    assert p03.found(c, h, ref, short).count() == 0
    assert p04.matched_rows(c, h, ref, short).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 55), (55, 60), (60, 50), (70, 70)] + [(100, 100 + i) for i in range(1, 30)]
    rows = people.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {r.rec: r.person for r in rows}
    assert len(rows) == len(got) == 41 + 3 + 30
    assert len({got[i] for i in range(41)}) == len({got[i] for i in (50, 55, 60)}) == len({got[i] for i in range(100, 130)}) == 1 and len(set(got.values())) == 3
    assert people.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_name_pairs_equal_brute_force(spark):
    """Asking for the rarest word, or beside an initial, finds every pair of names that aligns."""
    rng = random.Random(5)
    given, sur = ["mia", "ben", "benjamin", "anna", "robert", "m", "b", "r"], ["stone", "stoen", "reed", "reeds", "kivefirol", "kivefrol", "ng", "s", "k"]
    names = {tuple(sorted({*rng.sample(given, rng.randint(1, 2)), *rng.sample(sur, rng.randint(1, 2))})) for _ in range(70)}
    names = sorted(n for n in names if len(n) >= 2 and any(len(w) > 1 for w in n))
    rows = [(f"{i:03d}".encode(), "f1" if i % 2 else "f2", list(n), 3) for i, n in enumerate(names)]
    want = {(a, b) for a, fa, x, _ in rows for b, fb, y, _ in rows if a < b and fa == fb and people.align(x, y)[1]}
    got = people.name_pairs(spark.createDataFrame(rows, "name binary, firm string, toks array<string>, side int"))[1].collect()
    assert {(bytes(r.a), bytes(r.b)) for r in got} == want and len(got) == len(want) > 50


def test_driver_gives_its_heap_back_as_it_outgrows_its_share(spark, monkeypatch):
    mb = 1 << 20
    assert people.outgrown(400 * mb, 750 * mb, 0) and people.outgrown(700 * mb, 750 * mb, 600 * mb)
    assert not people.outgrown(300 * mb, 750 * mb, 0) and not people.outgrown(420 * mb, 750 * mb, 400 * mb)  # small, or all of it alive
    given = []
    monkeypatch.setattr(people, "outgrown", lambda *_: True)
    monkeypatch.setattr(people, "settle", given.append)
    monkeypatch.setattr(people, "EVERY", 0.1)
    slow = F.udf(lambda i: __import__("time").sleep(1) or i, "bigint")
    assert people.written(spark.range(2).repartition(1).select(slow("id").alias("x")), "slow").count() == 2
    assert len(given) > 3  # while the job ran, and after it
    before = len(given)
    assert people.components(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")).count() == 3 and len(given) > before


def test_sample_is_drawn_below_a_bound(spark):
    """The same rows as sorting all, but a task sends no more than its part of twice the sample."""
    rows = spark.range(0, 40_000, 1, 8).select("id", F.xxhash64("id").alias("o"))
    assert list(p04.smallest(rows, 100)["id"]) == [r.id for r in rows.orderBy("o").limit(100).collect()]
    low = rows.filter(F.col("o") <= p04.hashed_below(40_000, 100)).count()
    assert 100 <= low < 300  # sorting all sends up to 8 * 100 rows
    few = rows.filter("id < 50")
    assert len(p04.smallest(few, 100)) == 50 and len(p04.smallest(rows.limit(0), 100)) == 0
    skewed = rows.filter("o > 0")  # too few below the bound: all are sorted
    assert list(p04.smallest(skewed, 100)["id"]) == [r.id for r in skewed.orderBy("o").limit(100).collect()]


def test_retrieval_equals_scoring_every_pair(spark):
    rng = random.Random(7)
    vocabulary = [f"n:w{i}" for i in range(12)] + [f"q:w{i}|f" for i in range(12)] + [f"l:x{i}|f" for i in range(6)] + [f"m:b{i}" for i in range(6)]

    def side(n, start):
        return [(start + i, t) for i in range(n) for t in rng.sample(vocabulary, rng.randint(1, 7))]

    q, index = side(40, 0), side(60, 1000)
    akin = spark.createDataFrame([("f", "w1", "w1"), ("f", "w1", "w2"), ("f", "w2", "w1")], "firm string, word string, akin string")
    named = spark.createDataFrame([(i, 1000 + i) for i in range(0, 40, 5)], "c bigint, h bigint")
    qt, postings = p04.prepared(spark.createDataFrame(q, "ent bigint, term string"), spark.createDataFrame(index, "ent bigint, term string"), akin)
    got = {(r.c, r.h): r.score for r in p04.scored(qt, postings, named).collect()}
    pairs = spark.createDataFrame([(c, h) for c in range(40) for h in range(1000, 1060)], "c bigint, h bigint")
    rows = p04.scores(pairs, qt, postings).collect()
    every, worded = {(r.c, r.h): r.score for r in rows}, {r.h for r in rows if r.worded}
    keyed = lambda t: t[:2] in ("m:", "l:")
    eligible = {(c, h) for c, t in q for h, u in index if t == u and keyed(t)} | {(c, h) for c, h in ((i, 1000 + i) for i in range(0, 40, 5)) if (c, h) in every}
    least = {}
    for c, h in (p for p in eligible if p[1] in worded):
        least[c] = max(least.get(c, 0.0), p04.NEAR * every[c, h])
    want = {p: s for p, s in every.items() if p in eligible or s >= least.get(p[0], 1e9)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want) and len(want) > len(eligible)
