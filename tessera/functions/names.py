"""Name tokens, given name and surname, and the vocabulary of address formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold

# Honorifics that are no part of an address.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "mdm")
# Surnames by which a name's surname is found wherever it stands; a parameter.
SURNAMES = ("stone", "reed", "smith", "jones", "garcia", "novak", "tan", "singh")
SURNAME_AWARE = ("given.sur", "givensur", "allgiven.sur", "allgivensur", "sur.allgiven", "surallgiven", "f.sur", "fsur")


def name_tokens(name: Column) -> Column:
    """Bracketed and quoted nicknames off, accents folded, split at non-letters, honorifics off, lower case."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), r"[(\[\"“].*?[)\]\"”]", " ")
    parts = F.transform(F.split(fold(text), "[^A-Za-z]+"), lambda t: F.lower(t))
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*HONORIFICS))


def with_split_name(df: DataFrame, toks: str = "toks", surnames: tuple[str, ...] = SURNAMES) -> DataFrame:
    """Add given (array) and sur: the first token of the dictionary, else the last; null for one token."""
    t = F.col(toks)
    n = F.size(t)
    at = F.array_position(F.transform(t, lambda x: x.isin(*surnames)), F.lit(True)).cast("int")
    k = F.when(at > 0, at).otherwise(n)
    out = df.withColumn("__k", k)
    given = F.filter(t, lambda x, i: i != F.col("__k") - 1)
    return out.withColumn("given", F.when(n >= 2, given)).withColumn("sur", F.when(n >= 2, F.element_at(t, F.greatest(F.col("__k"), F.lit(1))))).drop("__k")


def formats(toks: Column, given: Column, sur: Column) -> dict[str, Column]:
    """Local part by format name; null where the name can't give it."""
    n = F.size(toks)
    first, last, mid = F.try_element_at(toks, F.lit(1)), F.try_element_at(toks, F.lit(-1)), F.try_element_at(toks, F.lit(2))
    all_given, one = F.array_join(given, ""), F.try_element_at(given, F.lit(1))

    def i(c: Column) -> Column:
        return F.substr(c, F.lit(1), F.lit(1))

    def two(a: Column, *parts: Column | str, b: Column = last) -> Column:
        return F.when((n >= 2) & (a != b), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    def aware(*parts: Column | str) -> Column:
        return F.when(sur.isNotNull(), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    initials = F.array_join(F.transform(F.slice(toks, F.lit(1), F.greatest(n - 1, F.lit(0))), i), "")
    return {
        "first.last": two(first, first, ".", last),
        "firstlast": two(first, first, last),
        "first_last": two(first, first, "_", last),
        "first-last": two(first, first, "-", last),
        "f.last": two(first, i(first), ".", last),
        "flast": two(first, i(first), last),
        "first.l": two(first, first, ".", i(last)),
        "firstl": two(first, first, i(last)),
        "fl": two(first, i(first), i(last)),
        "last.first": two(first, last, ".", first),
        "lastfirst": two(first, last, first),
        "lastf": two(first, last, i(first)),
        "first.mid": two(first, first, ".", mid, b=mid),
        "firstmid": two(first, first, mid, b=mid),
        "given.sur": aware(one, ".", sur),
        "givensur": aware(one, sur),
        "allgiven.sur": aware(all_given, ".", sur),
        "allgivensur": aware(all_given, sur),
        "sur.allgiven": aware(sur, ".", all_given),
        "surallgiven": aware(sur, all_given),
        "f.sur": aware(i(one), ".", sur),
        "fsur": aware(i(one), sur),
        "first": first,
        "last": last,
        "alltokens": F.when(n >= 2, F.array_join(toks, "")),
        "alltokens.": F.when(n >= 2, F.array_join(toks, ".")),
        "initials+last": F.when(n >= 2, F.concat(initials, last)),
    }


def candidates(df: DataFrame, *keep: str, unbuilt: bool = False) -> DataFrame:
    """One row per name and format: keep..., pattern, local; only formats that the name can give unless
    ``unbuilt``, which also adds place, the format's place by name."""
    made = formats(F.col("toks"), F.col("given"), F.col("sur"))
    order = {k: i for i, k in enumerate(sorted(made))}
    pairs = F.array(*[F.struct(F.lit(k).alias("pattern"), v.alias("local"), F.lit(order[k]).alias("place")) for k, v in made.items()])
    if unbuilt:
        return df.select(*keep, F.inline(pairs))
    return df.select(*keep, F.inline(F.filter(pairs, lambda p: p["local"].isNotNull()))).drop("place")
