"""Scalar cleaning as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# By rule: what is left of a character when its compatibility decomposition keeps ASCII only. One character
# each is left of most; ligatures and digraphs leave two or more.
_LEFT = {c: r for c in map(chr, (i for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)) if (r := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())}
ACCENTED = "".join(c for c, r in _LEFT.items() if len(r) == 1)
PLAIN = "".join(r for r in _LEFT.values() if len(r) == 1)
LIGATURES = {c: r for c, r in _LEFT.items() if len(r) > 1 and r.isalpha() and unicodedata.category(c) in ("Lu", "Ll", "Lt")}


def strip(c: Column) -> Column:
    """No-break spaces as spaces, outer white space off, empty as null."""
    return F.nullif(F.regexp_replace(F.translate(c, " ", " "), r"^\s+|\s+$", ""), F.lit(""))


def person_key(name: Column) -> Column:
    """Lower-case Latin letters only; a name without any gives null, so such rows never merge."""
    return F.nullif(F.regexp_replace(F.lower(name), "[^a-z]", ""), F.lit(""))


def fold(c: Column) -> Column:
    """Letters and digits of every style without accents, ligatures written out, everything else beyond ASCII dropped."""
    out = c
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.when(c.rlike(f"[{''.join(LIGATURES)}]"), out).otherwise(c)
    return F.regexp_replace(F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(out, ACCENTED, PLAIN)).otherwise(c), r"[^\x00-\x7f]", "")


def recode(c: Column, values: dict[str, str]) -> Column:
    """Known values mapped, others passed through."""
    out = F.lit(None).cast("string")
    for old, new in values.items():
        out = F.when(c == old, new).otherwise(out)
    return F.coalesce(out, c)


def without_placeholder(c: Column) -> Column:
    """null for n/a and na in any case."""
    return F.when(~F.lower(c).isin("n/a", "na"), c)


def join_notes(separator: str, *parts: Column) -> Column:
    """Non-empty parts joined; null if there is none."""
    return F.nullif(F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
