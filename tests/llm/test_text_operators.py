"""Problems 1, 8, 9, 10."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

pytest.importorskip("tessera.llm")
from tessera.llm import p01_canonical_text as p01
from tessera.llm import p08_tokenize as p08
from tessera.llm import p09_leakage as p09
from tessera.llm import p10_truncation as p10

VOCABULARY = os.path.join(p08.FOLDER, "byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(
    ("text", "want", "changed"),
    [
        ("Mia Stone", "Mia Stone", False), ("", "", False), ("José O’Neil \t\n", "José O’Neil \t\n", False), ("Анна Жуковец", "Анна Жуковец", False), ("佐伯 ゆう 고", "佐伯 ゆう 고", False),
        ("José", "José", True), ("Ｍｉａ　Ｓ", "Mia S", True), ("M​ia﻿", "Mia", True), ("Mia S", "Mia S", True), ("Rеbecca", "Rebecca", True), ("О'Bofoga", "O'Bofoga", True),
        ("𝐌𝐢𝐚", "Mia", True), ("ﬁne", "fine", True), ("e​́", "é", True), ("Sϲott", "Scott", True), ("Ϲarl", "Carl", True), ("ϲοφία", "ςοφία", True), ("Dɑn Wɡ", "Dan Wg", True), ("ᴍɪᴀ", "mia", True), ("Ꮇia Ꭺnna", "Mia Anna", True), ("Zoё", "Zoë", True), ("Mάx", "Máx", True), ("Məmməd", "Məmməd", False), ("Օlga", "Olga", True),
        ("ᏣᎳᎩ", "ᏣᎳᎩ", False), ("Հայկ", "Հայկ", False), ("́", "́", False), ("Αnna Σοφία", "Anna Σοφία", True), ("a´b", "a´b", False),
    ],
)
def test_canonical(text, want, changed):
    assert p01.canonical(text) == (want, changed)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_stable_and_agrees_with_whole_text_normalisation(text):
    once, _ = p01.canonical(text)
    assert p01.canonical(once)[0] == once
    # splicing gives what normalising everything that may change gives
    kept = "".join(" " if p01.odd_blank(c) else c for c in text if not p01.invisible(c))
    if all(unicodedata.normalize("NFKC", c)[:1] != " " for c in kept if c != " ") and not p01.FOREIGN_LETTER.search(once + kept) and not any(p01.invisible(c) or p01.odd_blank(c) for c in unicodedata.normalize("NFKC", kept)):
        assert once == unicodedata.normalize("NFKC", kept)


def test_plain_characters_are_canonical():
    import re

    for i in range(0x3000):
        if re.match(p01.PLAIN, chr(i)):
            assert p01.canonical("a" + chr(i) + "b") == ("a" + chr(i) + "b", False)


def test_canonical_column(spark):
    rows = [(1, "Rеbecca"), (2, None), (3, ""), (4, "x" * 100_000 + "​"), (5, "Rеbecca")]
    out = p01.with_canonical(spark.createDataFrame(rows, "canonical_text0 int, name string"), "name").orderBy("canonical_text0").collect()
    assert [(r.canonical_text, r.text_changed) for r in out] == [("Rebecca", True), (None, False), ("", False), ("x" * 100_000, True), ("Rebecca", True)]
    assert p01.with_canonical(spark.createDataFrame([], "name string"), "name").count() == 0


@lru_cache(maxsize=1)
def _encoder():
    return p08.Encoder(VOCABULARY)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
class TestTokens:
    @pytest.fixture
    def encoder(self):
        return _encoder()

    @pytest.fixture
    def other(self, encoder):
        import tiktoken

        return tiktoken.Encoding("own", pat_str=p08.PATTERN, mergeable_ranks=encoder.automaton.ranks, special_tokens={})

    @settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="abe t\n", max_size=80), st.text(alphabet="a的é😀", max_size=30)))
    def test_equals_the_public_encoder_and_decodes(self, encoder, other, text):
        text = text.encode("utf-8", "ignore").decode()
        ids = encoder.encode(text)
        assert ids == other.encode_ordinary(text)
        assert encoder.automaton.decode(ids).decode() == text

    def test_every_token_is_its_own_path(self, encoder):
        a = encoder.automaton
        assert all(a.path(t) == [i] for t, i in list(a.ranks.items())[::37])

    def test_column(self, spark, other):
        rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, "<|endoftext|>", "x"), (6, "ab" * 5000, "x"), (1, "Hello wörld", "x")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
        out = p08.encode(df).orderBy("doc_id").collect()
        assert [list(r.ids) for r in out] == [other.encode_ordinary(t or "") for _, t, _ in sorted(rows, key=lambda r: r[0])]
        back = {r.doc_id: r.text for r in p08.decode(p08.encode(df)).collect()}
        assert back == {i: t or "" for i, t, _ in rows}
        assert p08.encode(df.limit(0)).count() == 0


def test_leakage(spark):
    passage = "The Quick brown fox, jumps over the lazy dog and then it sleeps for hours near S$42 trees."
    items = spark.createDataFrame([(1, passage, "a"), (2, "too short to leak", "b"), (3, None, "c"), (4, passage, "d")], "item_id bigint, passage string, doc_id string")
    words = passage.split()
    docs = [
        (1, "Before. " + passage.upper() + " After."), (2, "x " + " -- ".join(words[2:14]) + " y"), (3, " ".join(words[:11])), (4, None), (5, ""), (6, "w " * 50_000 + passage), (7, passage.replace("lazy", "crazy")), (1, "again " + passage),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(map(tuple, p09.found(df, items).distinct().collect()))
    assert got == [(d, i) for d in (1, 2, 6) for i in (1, 4)]
    clean = {r.doc_id: r for r in p09.cleaned(df, items).collect()}
    assert set(clean) == {1, 2, 6} and clean[2].clean_text == "x  y" and clean[6].n_spans == 1
    assert p09.found(df, items.limit(0)).count() == 0 and p09.found(df.limit(0), items).count() == 0


def test_leakage_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "Dé", "e5"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(2, 20)))) for i in range(40)]

    def grams(t, n=4):
        w = t.lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = sorted((d, i) for d, t in texts for i, p in items if grams(t) & grams(p))
    old, p09.BLOCK_WORDS = p09.BLOCK_WORDS, 40  # several blocks
    try:
        got = p09.found(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, passage string"), 4)
        assert sorted(map(tuple, got.collect())) == want
    finally:
        p09.BLOCK_WORDS = old


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("All is well.", "sentence"), ('He said "yes".', "sentence"), ("很好。", "sentence"), ("All is well. 🙂", "sentence"), ("All is we", "open"), ("Fine. He said “no", "open"), ("Good. [mo", "open"), ("Good. Text [more]", "mark"), ("Good. Te>>", "mark"),
        ("Good. The (cont", "mark"), ("Good. Fo\n[connection", "mark"), ("Moved b&nb", "broken"), ("se�", "broken"), ("Time will tell…", "ellipsis"), ("Well.\nMany thanks,\nMR", "block"), ("Well.\n--\nBT\nadviser, Acme", "block"), ("Well.\n* one\n- two", "block"),
        ("Well.\nTags: a, b", "block"), ("Well.\nMore: https://a.test/x", "block"), ("Well. no rush", "close"), ("Gut. 👍", "sentence"), ("They said “maybe“, and so on.", "sentence"), ("See (a [b] c) \"d\" {e}.", "sentence"), ("Regards,\nMia\nBut it was late. And th", "open"),
        ("Kind regards,\nTom\nR&D", "block"), ("Best,\nAna\nP&G", "block"), ("Good.\nTotal: x=5", "block"), ("It came from AT&T", "open"), ("Up by 5%a", "open"), ("Fine. if a <b", "open"), ("Note (see " + "x" * 400 + ". Then more.", "held"), ("He said <b>hello and left. Then he came back.", "held"),
        ("He said <b>hello</b> and left.", "sentence"), ("One<br>two <img src='a'>.", "sentence"), ("<p>One.<p>Two.", "sentence"), ("See &amp; hear. And the &am", "broken"), ("x &#82", "broken"), ("caf=C3=A9 is closed. Th=C", "broken"), ('Go <a href="htt', "broken"), ("<i>a</i> and <b", "broken"), ("Good. \\u00e", "broken"),
        ("Regards,\n" + "\n".join(["Mia"] * 9), "block"), ("<!-- note. All well.", "held"), ("Mail <mia@acme.test> today.", "sentence"),
    ],
)
def test_endings(text, kind):
    assert p10.ending(text)[0] == kind


def test_truncation(spark):
    full, cut = "Sentence number {} ends here as it should.", "Sentence number {} is cut bef"
    rows = [(i, full.format(i) * 2, "a") for i in range(20)] + [(100 + i, (cut.format(i) + "x" * 60)[:50], "a") for i in range(6)]
    rows += [(200, None, "a"), (201, "", "a"), (202, " \n", None), (203, "Cut wor", None), (204, "All well.", None)] + [(300 + i, f"Okay {i}. over and out", "chat") for i in range(10)]
    rows += [(400, "Great. And th" + "x" * 300_000, "b"), (401, "Done." + " Done." * 30_000, "b"), (203, "Cut wor", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' as kind", "1 as chars")
    got = {r.doc_id for r in p10.found(df).collect()}
    assert got == {100 + i for i in range(6)} | {203, 400}  # the habit 'over and out' of chat is its own closing
    shares = {r.source: (r.n_texts, r.n_cut) for r in p10.shares(df).collect()}
    assert shares == {"a": (26, 6), None: (3, 2), "chat": (10, 0), "b": (2, 1)}
    assert p10.found(df.limit(0)).count() == 0


def test_codes_and_open_signs_by_source(spark):
    """A code at the end and a sign left open count by what the source does otherwise."""
    rows = [(i, f"Text {i} has 5%20less and more.", "coded") for i in range(20)] + [(50, "It is 5%2", "coded"), (51, "It is one.\nShare: 5%2", "plain"), (52, "One (of two.", "plain")]
    rows += [(100 + i, f"A smile :( in text {i}." if i % 3 == 0 else f"Text {i}.", "smiles") for i in range(30)] + [(200 + i, f"Plain {i}.", "plain") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in p10.found(df).collect()} == {50, 52}


def test_truncation_with_copies(spark):
    """Copies of one cut text are neither a limit nor a closing; a source may have two limits."""
    rows = [(i, "All is well. we then wen", "m") for i in range(60)]
    rows += [(100 + i, f"Text {i:02d} goes on and on for a while abou".ljust(77, "xyz"[i % 3]) + "...", "m") for i in range(12)]
    rows += [(200 + i, f"Text {i:02d} goes on and on for a while abou".ljust(197, "xyz"[i % 3]) + "...", "m") for i in range(12)]
    rows += [(300 + i, f"Text {i:02d} is whole" + " and so on" * (i % 7) + " as it should be.", "m") for i in range(30)]
    rows += [(400 + i, f"Text {i:02d} is whole" + " or so" * (5 + 9 * i) + "...", "m") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in p10.found(df).collect()} == {*range(60), *range(100, 112), *range(200, 212)}
