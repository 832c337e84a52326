"""Mailbox addresses: one form for each, and what a single slip in writing is. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
UNSEEN = "[\\u00ad\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufeff]"
EDGE = r"\s<>()\[\]{}\"'“”‘’,;:|\\"
ADDRESS = f"[^{EDGE}@]+@[^{EDGE}@]+[.][^{EDGE}@]+"

# Local parts of desks.
DESKS = (
    "info", "support", "marketing", "feedback", "claims", "compliance", "enquiries", "enquiry", "careers", "jobs", "sales", "contact",
    "admin", "office", "hello", "help", "service", "accounts", "billing", "press", "legal", "privacy", "team", "reception", "mail",
)


# Addresses that the steps below would leave as they are.
TIDY = r"^(?!u003)[a-z](?:[a-z0-9._-]*[a-z0-9])?@[a-z0-9][a-z0-9.-]*[.](?:[a-z0-9.-]*[a-z0-9])$"
STEPS = (
    ("%40", "@"),
    (r"%(20|3c|3e|22|09|0a|0d)|\+(?=\s|$)", " "),
    (r"\s*(?:[\[({<]\s*(?:at|@|ät)\s*[\])}>]|\s(?:at|_at_)\s(?=[^@]*$))\s*", "@"),
    (r"\s*(?:[\[({<]\s*(?:dot|\.|punkt)\s*[\])}>]|\sdot\s)\s*", "."),
    (r"\s*@\s*", "@"),
    (r"(?:mailto|e-?mail)\s*:", " "),
    (r"[?&#].*$", ""),
)
PARTS = (
    (r"\+[^@]*(?=@)", ""),
    (r"^[^\p{L}\p{N}@]+|[^\p{L}\p{N}@]+(?=@)|(?<=@)[^\p{L}\p{N}]+|[^\p{L}\p{N}@]+$", ""),
    (r"^(?:20|3c|3e|22|u003[ce])(?=\p{L}{3})", ""),  # what is left of an escape
)


def mailbox(column: Column) -> Column:
    """The address without case, markup, query, label, spelled-out signs and stray punctuation; null if
    there is none."""
    plain = F.lower(F.trim(column))
    s = F.lower(F.translate(F.regexp_replace(column, UNSEEN, ""), WIDE, NARROW))
    for pattern, new in STEPS:
        s = F.regexp_replace(s, pattern, new)
    s = F.regexp_extract(s, ADDRESS, 0)
    for pattern, new in PARTS:
        s = F.regexp_replace(s, pattern, new)
    return F.when(plain.rlike(TIDY), plain).otherwise(F.regexp_substr(s, F.lit("^[^@]+@[^@]*[.][^@]*$")))


def local_of(box: Column) -> Column:
    return F.substring_index(box, "@", 1)


def domain_of(box: Column) -> Column:
    return F.substring_index(box, "@", -1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal, or one letter more, less or other, or two neighbours swapped."""
    d = F.levenshtein(a, b, 2)
    n = F.length(a)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))
    swapped = (F.substr(a, same + 1, F.lit(2)) == F.reverse(F.substr(b, same + 1, F.lit(2)))) & (F.substr(a, same + 3) == F.substr(b, same + 3))
    return d.between(0, 1) | F.when((d == 2) & (n == F.length(b)), swapped).otherwise(False)


def same_but_slip(a: Column, b: Column) -> Column:
    """Are two addresses one mailbox but for at most one slip in each part? A different initial in front
    of a dot is another person; local parts that are both under four letters must be equal."""
    la, lb, da, db = local_of(a), local_of(b), domain_of(a), domain_of(b)
    initial = la.rlike("^.[._-]") & lb.rlike("^.[._-]") & (F.substr(la, F.lit(2)) == F.substr(lb, F.lit(2)))
    long = F.greatest(F.length(la), F.length(lb)) >= 4
    local = (la == lb) | (long & ~initial & within_one_edit(la, lb))
    return local & ((da == db) | within_one_edit(da, db))


# Bits of a key from the top: tree, what the tree keeps of the domain, what it keeps of both parts, the
# whole domain, the whole local part. A prefix of a key is a node of the tree.
LOCAL_BLOCKS, DOMAIN_BLOCKS = 4, 2
PLACE_BITS, NODE_BITS, REST_BITS = 14, 26, 10
EXACT, SAME_DOMAIN, ANY_SLIP = 0, REST_BITS, 2 * REST_BITS  # bits left off: how far a prefix is widened


def with_kept(df: DataFrame, part: str, blocks: int, tolerant: bool) -> DataFrame:
    """Each row once for every (class, j): what is left of ``part`` without its j-th block, for the length
    class that it (tolerant: also one a letter longer or shorter) is of; columns <part>_j and <part>_kept.

    A class holds the lengths 4k to 4k+3; its blocks have 4k/blocks letters, counted from the start for what
    stands before the block and from the end for what stands behind it, and two blocks overlap by a letter.
    So one letter more, less or other, or two neighbours swapped, always lies within one block."""
    text, n, c, j = F.col(part), F.length(part), F.col(f"{part}_c"), F.col(f"{part}_j")
    lengths = (F.greatest(n - 1, F.lit(0)), n + 1) if tolerant else (n,)
    out = df.withColumn(f"{part}_c", F.explode(F.array_distinct(F.array(*[m - m % 4 for m in lengths]))))
    out = out.withColumn(f"{part}_j", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    w = (c / blocks).cast("int")
    behind = F.greatest(c - (j + 1) * w - 1, F.lit(0))
    kept = F.concat_ws("|", c.cast("string"), F.substr(text, F.lit(1), j * w), F.substr(text, F.greatest(n - behind + 1, F.lit(1)), behind))
    return out.withColumn(f"{part}_kept", kept)


def _bits(n: int, *columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - n)


def with_keys(df: DataFrame, tolerant: bool, widened: int = EXACT) -> DataFrame:
    """Each row (column box) once for each of its signatures in the trees, in column key without the last
    ``widened`` bits: a node. Two addresses with at most one slip in each part share a node at ANY_SLIP when
    one side is taken tolerant; with a slip in the local part only also at SAME_DOMAIN."""
    out = df.withColumn("__l", local_of(F.col("box"))).withColumn("__d", domain_of(F.col("box")))
    out = with_kept(out, "__d", DOMAIN_BLOCKS, tolerant and widened == ANY_SLIP)
    out = with_kept(out, "__l", LOCAL_BLOCKS, tolerant)
    rest = F.shiftleft(_bits(REST_BITS, F.lit("d"), F.col("__d")), REST_BITS).bitwiseOR(_bits(REST_BITS, F.lit("l"), F.col("__l")))
    tree = F.col("__d_j").cast("bigint") * LOCAL_BLOCKS + F.col("__l_j")
    place = F.shiftleft(tree, PLACE_BITS).bitwiseOR(_bits(PLACE_BITS, F.col("__d_kept")))
    node = F.shiftleft(place, NODE_BITS).bitwiseOR(_bits(NODE_BITS, F.col("__d_kept"), F.col("__l_kept")))
    key = F.shiftright(F.shiftleft(node, 2 * REST_BITS).bitwiseOR(rest), widened)
    return out.withColumn("key", key).select(*df.columns, "key")


def with_whole_key(df: DataFrame) -> DataFrame:
    """Each row with its key in the first tree."""
    return with_keys(df, False).filter(F.shiftright("key", PLACE_BITS + NODE_BITS + 2 * REST_BITS) == 0)
