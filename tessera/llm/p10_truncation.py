"""Problem 10: texts that were cut by a field limit or in transfer.

Each text is read once and whole by a stack automaton over its structural signs: quotes, brackets, elements of
markup, comments, and the codes of a transfer (entities, percent and quoted-printable codes, escapes). It tells what
is still open at the end, inside of which code the text stops, and which families of codes it has seen whole. The end of
the text is classed: a sentence end, a sentence end with something left open, an ellipsis, a mark of a cut, a broken
code, the end of a structured block (signature, list, tags, link), a casual close, or open.

The verdict is taken against the baseline of the source, learned over all its different texts (copies count once): the
lengths, in characters or bytes, at which texts that end open pile up against the lengths around (its field limits),
the short closings its authors keep using, the families of codes its texts are written in, and whether its
sentences often leave a sign open. A text is cut if it ends in a mark; inside a code that can be nothing else, or of a
family that the text itself or its source uses; with something left open where that is no habit; open (and not in its
source's own closing); or stands at a limit of its source in an ellipsis or block whose end is not mostly found
away from the limits.

The baselines have one row per source, closing or limit; Spark broadcasts them while they are small.

Defined cases: null, empty and blank texts are not cut; a null source is a source of its own; ties
and repeated rows are judged alike; very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT_SHARE = 0.03  # of a source's different unfinished texts that have one exact length, at least
AROUND = 10  # lengths on each side, beyond the room of a mark, that a pile is held against
MARK_ROOM = 3  # characters that a mark of a cut may leave unused below the limit
CLOSING_SHARE = 0.01  # of a source's texts that end in one closing
HABIT_SHARE = 0.5  # of the texts with one end that stand away from the limits

# Closings that are common in messages.
CLOSINGS = {
    "thanks", "ok thanks", "many thanks", "thank you", "thx", "cheers", "best", "regards", "best wishes", "kind regards", "ok", "okay",
    "talk soon", "see you", "see you there", "see you soon", "no rush", "will do", "bye", "take care", "let me know", "ttyl", "noted", "lol",
    "danke", "viele grüße", "bis bald", "merci", "à bientôt", "谢谢",
}
GREETING = re.compile(r"(--+|(all the )?best|love|(many |with |kind |best |warm )?(thanks|regards|wishes|cheers|greetings|sincerely)( and regards)?|yours( sincerely| truly)?|(mit freundlichen|viele|beste) grüßen?|cordialement|bien à vous|此致)[,.!]?$", re.I)
FIELD = re.compile(r"[A-Z][\w ]{0,24}: ?(?!.{100})(?!.*[.!?] )\S.*$")
BULLET = re.compile(r"([-*•–·]|\d{1,3}[.)])\s+\S")
LINK = re.compile(r"(https?://|www\.)\S+$", re.I)
HASHTAGS = re.compile(r"(#\w+\s*)+$")
ELLIPSIS = re.compile(r"(\.\.\.+|…+|\. \. \.)$")
TERMINAL = re.compile(r"[.!?。！？؟।](?:[\"”’')\]}»›」』*_]|\s)*$")
MARK = re.compile(r"(\[[^\[\]\n]{0,40}\]|\((?:more|cont|continued|cut|truncated)[^()\n]{0,20}\)?|\[(?:connection|message|truncated|cut|snip|more|\.\.\.|…)[^\[\]\n]{0,40}|>>+|»|<more>)$", re.I)
MARK_WORD = re.compile(r"more|cont|cut|clip|trunc|snip|connection|lost|limit|abbrev|\.\.\.|…|>>|»", re.I)
# Names of entities, elements that are never closed, and elements whose end may be left out.
ENTITIES = ("amp", "nbsp", "quot", "apos", "copy", "hellip", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "euro", "eacute", "egrave", "uuml", "ouml", "auml", "szlig", "middot", "bull", "lt", "gt")
EMPTY = frozenset("br hr img input meta link area base col embed source track wbr".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup html head body".split())
# Families of codes, as they look whole and as they look when the text stops inside one. "tag" is read by the automaton.
FAMILIES = ("tag", "entity", "percent", "quoted", "escape")
WHOLE = {"entity": r"&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,30});", "percent": r"%[0-9A-Fa-f]{2}(?=%|[A-Za-z/_-])", "quoted": r"=(?:[0-9A-F]{2}|\r?\n)", "escape": r"\\(?:u[0-9a-f]{4}|x[0-9a-f]{2}|[nrt\"])"}
STOPPED = {"entity": re.compile(r"&(?:#x?[0-9a-f]{0,6}|[a-z]{0,30})$", re.I), "percent": re.compile(r"%[0-9A-Fa-f]?$"), "quoted": re.compile(r"=[0-9A-F]?$"), "escape": re.compile(r"\\(?:u[0-9a-f]{0,3}|x[0-9a-f]?)?$")}
TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*|/)?>|<!--|-->"
TAG_OPEN = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)?(\s[^<>]*)?$|<!-?$")
STRUCTURE = re.compile(f"(?P<tag>{TAG})|(?P<entity>{WHOLE['entity']})|(?P<percent>{WHOLE['percent']})|(?P<quoted>{WHOLE['quoted']})|(?P<escape>{WHOLE['escape']})|(?P<sign>[\"“”„«»()\\[\\]{{}}])")
SIGN = re.compile(r"[\"“”„«»()\[\]{}<&%=\\]|-->")  # where a structural sign can begin
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
SPLIT = re.compile(r"[.!?。！？…]+[\"”’')\]]*(?:\s|$)|[。！？]|\n")
CODE_SHARE = 0.01  # of a source's different texts that hold whole codes of a family: then it is a coded source
HELD_SHARE = 0.05  # of a source's different texts with a sentence end that leave something open: then it is its habit


def automaton(text: str) -> tuple[list[str], int]:
    """What the stack automaton holds at the end of the text (open quotes, brackets and elements, in order), and a bit for
    each family of codes of which it has read a whole one. A closing sign takes everything off above its opening one; one
    without an opening is passed over."""
    stack: list[str] = []
    held: Counter[str] = Counter()
    families = 0

    def push(sign: str) -> None:
        stack.append(sign)
        held[sign] += 1

    def close(*openings: str) -> None:
        if any(held[o] for o in openings):
            while True:
                top = stack.pop()
                held[top] -= 1
                if top in openings:
                    return

    end = 0
    for sign in SIGN.finditer(text):
        if sign.start() < end or not (m := STRUCTURE.match(text, sign.start())):
            continue
        end, kind, c = m.end(), m.lastgroup, m[0]
        if kind != "sign":
            families |= 1 << FAMILIES.index(kind)
        if kind == "tag":
            name = re.sub(r"[^a-z0-9-].*", "", c.lstrip("</").lower(), flags=re.S)
            if c == "<!--":
                push(c)
            elif c == "-->":
                close("<!--")
            elif name in EMPTY or c.endswith("/>"):
                continue
            elif c.startswith("</"):
                close("<" + name)
            else:
                push("<" + name)
        elif kind == "sign":
            if c == '"' and held['"']:
                close('"')
            elif c == "“" and held["“"] + held["„"]:
                close("“", "„")
            elif c in PAIRS:
                close(PAIRS[c])
            elif c != '"' or m.start() == 0 or not text[m.start() - 1].isdigit():
                push(c)
    return [x for x in stack if x[1:] not in LOOSE], families


def stopped_code(text: str) -> tuple[str, bool]:
    """(family of the code that the text stops inside of, whether it can be nothing else). ``text`` has no blank at its end."""
    if text.endswith("�"):
        return "byte", True
    if TAG_OPEN.search(text, max(text.rfind("<"), 0)) and "<" in text:
        start = text.rfind("<")
        return "tag", bool(re.match(r"</[A-Za-z]|<[A-Za-z][A-Za-z0-9-]*\s+[A-Za-z-]+\s*=", text[start:]))
    for family, pattern in STOPPED.items():
        if m := pattern.search(text):
            name = m[0][1:]
            sure = family == "entity" and (len(name) >= 2 and (name[0] == "#" or any(e.startswith(name) for e in ENTITIES)))
            return family, sure or (family == "escape" and len(m[0]) >= 3)
    return "", False


def ending(text: str) -> tuple[str, str, str, int]:
    """(class of the end, what follows the last sentence end, family of a code that the text may stop inside of, bits of
    the families of whole codes)."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("So", "Sk", "Mn", "Cf")):
        end -= 1
    decorated = any(unicodedata.category(c) == "So" and c != "�" for c in text[end:])
    body = text[:end]
    if not body:
        return ("close" if decorated else "broken" if "�" in text else "blank"), "", "", 0
    raw = text.rstrip()
    held, families = automaton(text)
    code, sure = ("", False) if decorated or LINK.search(raw) else stopped_code(raw)
    if code and (sure or (code in FAMILIES and families >> FAMILIES.index(code) & 1)):
        return "broken", "", code, families
    if (m := MARK.search(body)) and MARK_WORD.search(m[0]):
        return "mark", "", code, families
    lines = body.split("\n")
    last = lines[-1].strip()
    tail = SPLIT.split(body)[-1].strip()
    if m := ELLIPSIS.search(body):
        # the words before the ellipsis, since the sentence end before them
        return "ellipsis", SPLIT.split(body[: m.start()].rstrip())[-1].strip() or last, code, families
    if TERMINAL.search(body):
        return ("held" if held else "sentence"), "", code, families
    # a signature is a greeting and short lines without a sentence between
    k = len(lines) - 2
    while k >= 0 and not (signed := bool(GREETING.match(lines[k].strip()))) and len(lines[k].strip()) <= 80 and not re.search(r"[.!?] ", lines[k].strip()):
        k -= 1
    signed = k >= 0 and signed and len(last) <= 80 and not re.search(r"[.!?] ", last)
    if decorated:
        return "close", tail, code, families
    if len(lines) > 1 and (signed or GREETING.match(last) or FIELD.match(last) or BULLET.match(last) or LINK.match(last) or HASHTAGS.match(last)):
        return "block", re.split(r", |: |^[-*•–·] ", last)[-1], code, families
    if tail.lower().strip(" ,!-") in CLOSINGS:
        return "close", tail.lower(), code, families
    return "open", tail, code, families


def _endings(texts: pd.Series) -> pd.DataFrame:
    out = [("blank", "", "", 0) if not t or not t.strip() else ending(t) for t in texts]
    return pd.DataFrame(out, columns=["kind", "tail", "code", "families"])


def with_endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, kind, tail, code, families, chars, bytes, hash (of the text) of every text that is not blank."""
    run = F.pandas_udf(_endings, "struct<kind: string, tail: string, code: string, families: int>")
    docs = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text").filter("text is not null")
    docs = docs.withColumn("e", run("text")).select("doc_id", "source", "e.kind", "e.tail", "e.code", "e.families", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))
    return docs.filter("kind <> 'blank'")


def limits(texts: DataFrame) -> DataFrame:
    """source, char_limits, byte_limits: the lengths at which the unfinished of a source's different texts
    pile up; by_bytes tells which pile is higher. Of lengths within the room of a mark the highest counts."""
    unfinished = texts.filter("kind in ('open', 'ellipsis', 'mark', 'broken')")
    total = unfinished.groupBy("source").agg(F.count("*").alias("n"))
    units = F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("size")))
    piles = unfinished.select("source", F.inline(units)).groupBy("source", "unit", "size").agg(F.count("*").alias("k"))
    # what stands at the lengths around: range windows over sizes, far fewer than the texts
    by_size, room = W.partitionBy("source", "unit").orderBy("size"), MARK_ROOM + AROUND
    near = [F.coalesce(F.sum("k").over(by_size.rangeBetween(x, y)), F.lit(0)) for x, y in ((-room, -MARK_ROOM - 1), (MARK_ROOM + 1, room))]
    piles = piles.withColumn("mean", (near[0] + near[1]) / F.lit(2.0 * AROUND)).withColumn("top", F.max("k").over(by_size.rangeBetween(-MARK_ROOM, MARK_ROOM)))
    high = piles.join(total, "source").filter(f"k = top and k >= 3 and k >= mean + 5 * sqrt(mean) + 2 and k >= {LIMIT_SHARE} * n")

    def of(unit: str, value: str):
        return F.when(F.col("unit") == unit, F.col(value))

    out = high.groupBy("source").agg(F.collect_list(of("c", "size")).alias("char_limits"), F.collect_list(of("b", "size")).alias("byte_limits"), F.max(of("c", "k")).alias("kc"), F.max(of("b", "k")).alias("kb"))
    return out.select("source", "char_limits", "byte_limits", (F.coalesce("kb", F.lit(0)) > F.coalesce("kc", F.lit(0))).alias("by_bytes"))


def closings(texts: DataFrame) -> DataFrame:
    """source, tail: short last phrases without a stop that a source's authors keep using in different texts."""
    total = texts.groupBy("source").agg(F.count("*").alias("n"))
    own = texts.filter("kind = 'open' and size(split(tail, ' ')) <= 4 and length(tail) <= 24").groupBy("source", "tail").agg(F.count("*").alias("k"))
    return own.join(total, "source").filter(f"k >= 5 and k >= {CLOSING_SHARE} * n").select("source", "tail")


def habits(texts: DataFrame) -> DataFrame:
    """source, coded (families of codes that its texts use), leaves_open: its sentences often leave something open."""
    coded = [F.when(F.count_if(F.col("families").bitwiseAND(1 << i) > 0) >= CODE_SHARE * F.count("*"), f) for i, f in enumerate(FAMILIES)]
    open_, ends = F.count_if(F.col("kind") == "held"), F.count_if(F.col("kind").isin("held", "sentence"))
    return texts.groupBy("source").agg(F.array_compact(F.array(*coded)).alias("coded"), ((open_ >= 3) & (open_ >= HELD_SHARE * ends)).alias("leaves_open"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, kind, cut of every text that is not blank."""
    from ..session import written

    ends = written(with_endings(documents), "endings")  # read by the baselines and the verdict
    texts = written(ends.dropDuplicates(["source", "hash"]).drop("doc_id"), "texts")  # copies teach nothing more
    lim, own = limits(texts), closings(texts).withColumn("own", F.lit(True))

    def placed(df: DataFrame) -> DataFrame:
        """Add at_limit: does a text stand at a limit of its source?"""
        def within(limit: str, size: str):
            return F.exists(limit, lambda x: (x - F.col(size)).between(0, MARK_ROOM))

        marked = within("char_limits", "chars") | within("byte_limits", "bytes")
        exact = F.when(F.col("by_bytes"), F.array_contains("byte_limits", F.col("bytes"))).otherwise(F.array_contains("char_limits", F.col("chars")))
        out = df.join(lim, "source", "left")
        return out.withColumn("at_limit", F.coalesce(F.when(F.col("kind") == "ellipsis", marked).otherwise(exact), F.lit(False)))

    rows = placed(ends).join(own, ["source", "tail"], "left").join(habits(texts), "source", "left")
    rows = rows.withColumn("kind", F.when((F.col("code") != "") & F.array_contains("coded", F.col("code")), "broken").when((F.col("kind") == "held") & F.col("leaves_open"), "sentence").otherwise(F.col("kind")))
    # ends that mostly stand elsewhere, away from the limits, are the authors' own
    away = placed(texts.filter("kind in ('ellipsis', 'block')")).groupBy("kind", "tail").agg(F.count_if(~F.col("at_limit")).alias("k"), F.count("*").alias("n"))
    habit = away.filter(f"k >= 3 and k >= {HABIT_SHARE} * n")
    asked = rows.filter("kind in ('ellipsis', 'block') and at_limit").select("doc_id", "kind", "tail")
    known = asked.join(habit, ["kind", "tail"], "left_anti").select("doc_id")
    plain = F.col("kind").isin("mark", "broken", "held") | ((F.col("kind") == "open") & F.col("own").isNull())
    return rows.join(known.distinct().withColumn("stopped", F.lit(True)), "doc_id", "left").select("doc_id", "source", "kind", (plain | (F.col("stopped").isNotNull() & F.col("at_limit"))).alias("cut"))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).filter("cut").select("doc_id")


def shares(documents: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, share_cut: how often each source truncates (blank texts left out)."""
    out = judged(documents).groupBy(F.nullif("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return out.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6))
