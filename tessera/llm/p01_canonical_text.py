"""Problem 1: text that looks the same gets the same characters.

Unicode quick-check properties tell which characters can change under NFKC or join with the
character before them. Runs of those (plus one stable character to the left, the only one that can
take part in a composition) are cut out, normalised alone and spliced back; the rest of the text is
never touched. Invisible characters go, blanks become a space, and foreign look-alike letters in a
word that also has Latin letters become the Latin ones, with the accents they carry. Those that normalisation would
turn into another letter of their alphabet (the lunate sigmas) are replaced before it.

Defined cases: null stays null, an empty text stays empty, any length is processed whole, words
wholly in one other script, ordinary accented letters and typographic quotes stay as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that are drawn like a Latin letter: Greek, Cyrillic, Armenian, Cherokee, phonetic.
FOREIGN = (
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ" "αονικρυϲϳ"
    "АВЕЅІЈКМНОРСТУХҮԌԛԜԁһ" "аеѕіјорсухԝӏҮвгкмтпшь" "ВГԚԐᎪ"
    "ՍՕՏԼոսօհցզյ"
    "ᎡᎢᎥᎫᎬᎳᎷᎻᏀᏂᏃᏚᏞᏟᏢᏦᏴᏙᏔ"
    "ɑɡɩʋ"
)
LATIN = (
    "ABEZHIKMNOPTYXCMJ" "aovikpucj"
    "ABESIJKMHOPCTYXYGqWdh" "aesijopcyxwlYbrkmtnwb" "BГQEA"
    "UOSLnuohgqj"
    "RTiJEWMHGhZSLCPKBVW"
    "agiv"
)
LOOK_ALIKE = {ord(a): b for a, b in zip(FOREIGN, LATIN, strict=True)}
# by rule: small capitals are the letter in their name
LOOK_ALIKE |= {i: m[1].lower() for i in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D30), *range(0xA730, 0xA732)) if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(i), "")))}
# those that normalisation would turn into another letter of their alphabet first
EARLY = {i: c for i, c in LOOK_ALIKE.items() if unicodedata.normalize("NFKC", chr(i)) != chr(i)}

# Texts of only these characters are already canonical; the test stays in the JVM.
PLAIN = r"^[\x09\x0a\x0d\x20-\x7eÀ-ıĴ-ľŁ-ňŊ-ž‘-‟]*$"

# Format characters that are drawn, and marks and fillers that are not.
DRAWN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
UNDRAWN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ord(c) not in DRAWN_FORMAT
    return ord(c) in UNDRAWN or (kind == "Cc" and c not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85")


def odd_blank(c: str) -> bool:
    return c in "\x0b\x0c\x1c\x1d\x1e\x1f\x85⠀" or (unicodedata.category(c) in ("Zs", "Zl", "Zp") and c != " ")


@lru_cache(maxsize=1)
def unstable_run() -> re.Pattern[str]:
    """Runs of characters whose quick check is No or Maybe, that have a combining class, or that are not drawn."""
    second = set()  # characters that can join with one before them
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", c) == c:
            second.add(int(parts.split()[1], 16))
    second |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i <= 0xDFFF or 32 <= i < 0x7F or c in "\t\n\r":
            continue
        bad = i in second or unicodedata.combining(c) != 0 or invisible(c) or odd_blank(c)
        if not bad and not unicodedata.is_normalized("NFKC", c):
            flat = unicodedata.normalize("NFKC", c)
            bad = not (flat[0] == " " and len(flat) > 1)  # a spacing accent is plain as it stands
        if bad:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    inner = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[^{inner}]?[{inner}]+", re.DOTALL)


WORD = re.compile(r"[^\W\d_]+")
CHUNK = re.compile(r"[^\W\d_]+(?:['’.][^\W\d_]+)*")
FOREIGN_LETTER = re.compile("[Ͱ-ԯԱ-ևᎠ-ᏽꭰ-ꮿᲀ-᲏ἀ-῿]")
DRAWN_LIKE = re.compile(f"[{''.join(map(chr, LOOK_ALIKE))}]")
PHONETIC = re.compile(f"[{''.join(chr(i) for i in LOOK_ALIKE if 0x250 <= i < 0x2B0 or 0x1D00 <= i < 0x1D30 or i >= 0xA730)}]")
EARLY_LETTER = re.compile(f"[{''.join(map(chr, EARLY))}]")
LATIN_LETTER = re.compile("[A-Za-zÀ-ɏḀ-ỿ]")


def _segment(match: re.Match[str]) -> str:
    text = "".join(" " if odd_blank(c) else c for c in match[0] if not invisible(c))
    return "".join(" " if odd_blank(c) else c for c in unicodedata.normalize("NFKC", text) if not invisible(c))


def _flat(word: str) -> str:
    """Look-alike letters as Latin ones; accents stay on their letter."""
    if not word.isascii() and not DRAWN_LIKE.search(word):
        parts = unicodedata.normalize("NFD", word)
        return unicodedata.normalize("NFC", parts.translate(LOOK_ALIKE)) if DRAWN_LIKE.search(parts) else word
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(LOOK_ALIKE))


def canonical(text: str) -> tuple[str, bool]:
    """The canonical text, and whether the given one held anything else."""
    out = text
    if EARLY_LETTER.search(out):
        out = re.sub(r"\S+", lambda m: m[0].translate(EARLY) if LATIN_LETTER.search(m[0]) else m[0], out)
    out = unstable_run().sub(_segment, out)
    mixed = False
    if FOREIGN_LETTER.search(out) or DRAWN_LIKE.search(out):

        def word(m: re.Match[str]) -> str:
            nonlocal mixed
            w, flat = m[0], _flat(m[0])
            if flat != w and not FOREIGN_LETTER.search(w):  # phonetic letters and small capitals only
                mixed = True
                return flat
            if FOREIGN_LETTER.search(w) and (LATIN_LETTER.search(w) or not FOREIGN_LETTER.search(flat)):
                mixed = True
                return flat
            return w

        # a letter joined to Latin letters by an apostrophe or a full stop belongs to their word
        out = CHUNK.sub(lambda m: WORD.sub(word, m[0]) if LATIN_LETTER.search(m[0]) or PHONETIC.search(m[0]) else m[0], out)
    # dropping an invisible character may bring a mark next to its letter
    if unstable_run().search(out):
        out = unicodedata.normalize("NFKC", out)
    return out, mixed or out != text


def _canonical_batch(texts: pd.Series) -> pd.DataFrame:
    pairs = [(None, False) if t is None else canonical(t) for t in texts]
    return pd.DataFrame(pairs, columns=["text", "changed"])


def with_canonical(df: DataFrame, column: str, out: str = "canonical_text", changed: str = "text_changed") -> DataFrame:
    """Add the canonical form of ``column`` and whether it differs. Only texts with other than plain
    characters travel to Python; no shuffle."""
    c = F.col(column)
    run = F.pandas_udf(_canonical_batch, "struct<text: string, changed: boolean>")
    done = run(F.when(~c.rlike(PLAIN), c))
    return (
        df.withColumn("__canon", done)
        .withColumn(out, F.coalesce(F.col("__canon.text"), c))
        .withColumn(changed, F.coalesce(F.col("__canon.changed"), F.lit(False)))
        .drop("__canon")
    )


def spelling(column: Column) -> Column:
    """Letters and digits in lower case of a canonical text: its spelling."""
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]", ""))
