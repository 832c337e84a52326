from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import emails, extract
from tessera.functions.names import formats as make_formats
from tessera.functions.names import name_tokens, with_split_name
from tessera.operators import formats, mail


def test_tokens_and_formats(spark):
    names = ["Dr Mia Stone", "Mia Stone Lux Orr", "Stone Lux Orr", "Ivo Kale (Vee)", "Zed", "Ána-Léa O'Neil", "", None]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string").withColumn("toks", name_tokens(F.col("name")))
    df = with_split_name(df, "toks", ("stone", "reed"))
    made = make_formats(F.col("toks"), F.col("given"), F.col("sur"))
    out = df.select("id", "toks", "given", "sur", *[made[p].alias(p.replace(".", "_")) for p in ("given.sur", "allgiven.sur", "first.last", "initials+last")]).orderBy("id").collect()
    assert [r.toks for r in out] == [["mia", "stone"], ["mia", "stone", "lux", "orr"], ["stone", "lux", "orr"], ["ivo", "kale"], ["zed"], ["ana", "lea", "o", "neil"], [], []]
    assert [(r.given, r.sur) for r in out[:5]] == [(["mia"], "stone"), (["mia", "lux", "orr"], "stone"), (["lux", "orr"], "stone"), (["ivo"], "kale"), (None, None)]
    assert [(r.given_sur, r.allgiven_sur, r.first_last) for r in out[:5]] == [
        ("mia.stone", "mia.stone", "mia.stone"), ("mia.stone", "mialuxorr.stone", "mia.orr"), ("lux.stone", "luxorr.stone", "stone.orr"), ("ivo.kale", "ivo.kale", "ivo.kale"), (None, None, None),
    ]


def book(spark):
    rng = random.Random(3)
    given, sur = ["mia", "ivo", "ana", "bo", "lux"], ["stone", "kale", "orr", "reed", "voss", "lind"]
    rows = []
    for i in range(60):
        g, s = rng.choice(given), rng.choice(sur)
        d = rng.choice(["a.test", "b.test", "c.test"])
        mail_ = {"a.test": f"{g}.{s}", "b.test": f"{g[0]}{s}", "c.test": f"{g}{s}lx"}[d]
        if rng.random() < 0.1:
            mail_ = f"{s}.{g}"
        rows.append((i, f"{g.title()} {s.title()}", None if rng.random() < 0.2 else f"{mail_}@{d}", "Firm " + d))
    rows += [(100, "Zed", "zed@d.test", "D"), (101, "Ana Orr", "info@a.test", "Firm a.test"), (102, None, "x@e.test", None), (103, "Bo Reed", "bo@gmail.com", "G"), (104, "Bo Reed Lind", None, "Firm a.test"), (105, "Q", None, "nowhere")]
    return spark.createDataFrame(rows, "id bigint, name string, email string, firm string")


def test_leave_one_out_equals_relearning(spark):
    rows = formats.learnable(book(spark)).cache()
    got = {r.domain: (r.n, r.correct) for r in formats.leave_one_out(rows).collect()}
    ids = [(r.id, r.domain, r.actual) for r in rows.collect()]
    want: dict[str, list] = {}
    made = {(r.id, r.pattern): r.local for r in formats.candidates(rows, "id").collect()}
    from tessera.functions.names import SURNAME_AWARE

    patterns = sorted({p for _, p in made})
    for d in {x[1] for x in ids}:
        own = [x for x in ids if x[1] == d]
        if len(own) < 3:
            want[d] = (len(own), None)
            continue
        right = 0
        for held in own:
            best = None
            for p in patterns:
                rest = [x for x in own if x != held and (x[0], p) in made]
                if len(rest) >= max(1, (len(own) - 1) // 2):
                    rate = sum(made[x[0], p] == x[2] for x in rest) / len(rest)
                    key = (-rate, p not in SURNAME_AWARE, p)
                    best = min(best, key) if best else key
            right += bool(best and best[0] < 0 and made.get((held[0], best[2])) == held[2])
        want[d] = (len(own), right)
    assert got == want


def test_models_and_predictions(spark):
    b = book(spark)
    m = {r.domain: r for r in formats.models(formats.learnable(b)).collect()}
    assert m["a.test"].pattern == "allgiven.sur" and m["a.test"].predictable
    assert not m["c.test"].predictable and m["c.test"].confidence >= 0.6
    assert "gmail.com" not in m and m["d.test"].samples == 1
    g = formats.guesses(b)
    p, n = formats.predictions(g).collect(), formats.needs_manual(g).collect()
    assert {r.status for r in p} == {"unverified prediction"} and all("@" in r.predicted_email for r in p)
    why = {r.id: r.why for r in n}
    assert why[105] == "no known domain for this firm" and why[104].startswith("multi-part name (candidates: ")
    assert {r.id for r in p} | set(why) == {r.id for r in b.collect() if r.name and "@" not in (r.email or "")}


def test_classify(spark):
    cases = [("bad@", "malformed"), ("a@yopmail.com", "disposable domain"), ("a@dead.test", "domain accepts no mail"), ("a@none.test", "MX lookup failed"), ("Info@acme.test ", "role account (a desk, not a person)"), ("mia@gmail.com", "personal free mailbox"), ("mia@acme.test", "ok"), (None, "malformed")]
    mx = spark.createDataFrame([("yopmail.com", True), ("dead.test", False), ("none.test", None), ("acme.test", True), ("gmail.com", True)], "domain string, has_mx boolean")
    out = mail.classified(spark.createDataFrame([(i, e) for i, (e, _) in enumerate(cases)], "i int, email string"), mx).orderBy("i").collect()
    assert [r.note for r in out] == [n for _, n in cases]
    assert [r.sendable for r in out] == [False, False, False, False, True, True, True, False]


def test_extract(spark):
    html = [
        '<li>Mia Stone <a href="mailto:mia.stone@acme.com?subject=x">m</a></li>', '<li>Mia Stone <a href="mailto:mia%2Estone@acme.com">m</a></li>', "<p>ask@acme.com. If you</p>", "mia [at] acme [dot] com", "estate. Investment",
        "user@example.com", "logo@2x.png", "with@acme.com", '<a href="mailto:with@acme.com">w</a>', '<a data-cfemail="2a4b6a480449">x</a>', "ab@firm.com.br and ab@x.capital.com.sg", None, "",
    ]
    want = [["mia.stone@acme.com"], ["mia.stone@acme.com"], ["ask@acme.com"], ["mia@acme.com"], [], [], [], [], ["with@acme.com"], ["a@b.c"], ["ab@firm.com.br", "ab@x.capital.com.sg"], [], []]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id int, url string, html string")
    rows = extract.page_hits(pages).collect()
    assert [sorted(r.email for r in rows if r.page_id == i) for i in range(len(html))] == want
    assert {r.page_id: (r.nearby_name, r.is_role) for r in rows if r.page_id < 3} == {0: ("Mia Stone", False), 1: ("Mia Stone", False), 2: (None, True)}
    one = spark.createDataFrame([("a@b.c",)], "e string").select(extract.decode_hex(extract.encode_hex(F.col("e"), 42)).alias("e"), extract.decode_hex(F.lit("zz")).alias("bad")).first()
    assert one.e == "a@b.c" and one.bad is None


def test_suffixes_desks_and_links(spark):
    text = "a.b@firm.ru, cd@firm.co.il; ef@firm.sa. gh@firm.zz"
    df = spark.createDataFrame([(text, "pdpa", "press")], "t string, r string, p string")
    got = df.select(extract.addresses(F.col("t")), extract.addresses(F.col("t"), ["zz"]), emails.is_role(F.col("r")), emails.is_role(F.col("p")), emails.is_role(F.col("p"), ["press"])).first()
    assert list(got) == [["a.b@firm.ru", "cd@firm.co.il", "ef@firm.sa"], ["gh@firm.zz"], True, False, True]
    html = '<a href="/team#x">t</a> <A class=b href=\'https://other.com/x\'>o</A> <a href="//cdn.com/y">c</a><a href="mailto:a@b.c">m</a> <a href="/team">t</a>'
    assert spark.createDataFrame([(html, "https://acme.com/start?x")], "h string, u string").select(extract.hrefs(F.col("h"), F.col("u"))).first()[0] == ["https://acme.com/team", "https://other.com/x"]


def test_frontier(spark):
    links = [f"https://www.acme.com/p{k}" for k in range(15)] + ["https://acme.com/team", "https://acme.com/a.pdf", "https://other.com/x", "https://acme.com/about?q"]
    rows = [(1, "acme.com", n, u) for n, u in enumerate(links)] + [(2, "acme.com", 0, links[0]), (2, "acme.com", 1, "https://acme.com/new")]
    df = spark.createDataFrame(rows, "page_id int, site string, n int, url string")
    got = [r.url for r in extract.frontier(df).orderBy("place").collect()]
    assert got == ["https://acme.com/team", "https://acme.com/about?q", *links[:10], "https://acme.com/new"]  # a link over the ten of its page is dropped
    assert [r.url for r in extract.frontier(df, 3, 4).orderBy("place").collect()] == ["https://acme.com/team", "https://acme.com/about?q", *links[:2]]


def test_page_counters(spark):
    h = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/x"), ("a", "https://a/shut/y"), ("b", None)], "domain string, source_url string")
    assert [tuple(r) for r in mail.page_counters(h, "domain", ("/shut",)).collect()] == [("a", 2, 1)]


def test_hosts(spark):
    hosts = {"www.acme.com.sg": "acme.com.sg", "a.co.uk": "a.co.uk", "x.y.acme.com": "acme.com", "acme": "acme", "team.acme.sg": "acme.sg"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.s for r in df.select("h", emails.registrable(F.col("h")).alias("s")).collect()} == hosts


def test_import_set(spark):
    known = spark.createDataFrame([(1, "Mia Stone", "mia@acme.test", "Acme", "Adviser"), (2, "Bo Reed", None, "Birch", "Consultant"), (3, "99", None, None, None)], "id bigint, name string, email string, firm string, ctype string")
    pred = spark.createDataFrame([(2, "Bo Reed", "Birch", "bo.reed@birch.test", 91, "unverified prediction"), (1, "Mia", "Acme", "MIA@acme.test", 90, "unverified prediction")], "id bigint, name string, firm string, email string, confidence_pct int, status string")
    crawl = spark.createDataFrame([(7, None, "bo.reed@birch.test", "u", "ok"), (8, None, "new@x.test", "u" * 400, "ok"), (9, "A B", "late@x.test", "u", "MX lookup failed")], "id bigint, name string, email string, found_on string, status string")
    out = {r.email: r for r in mail.import_set(known, pred, crawl).collect()}
    assert set(out) == {"bo.reed@birch.test", "new@x.test"}
    assert out["bo.reed@birch.test"].source == "Pattern prediction" and out["bo.reed@birch.test"].ctype == "Consultant" and out["bo.reed@birch.test"].already_held.startswith("yes")
    assert out["new@x.test"].name == "new" and len(out["new@x.test"].notes) == 250
