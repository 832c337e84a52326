"""Problem 6: free-entered values are mapped to the entry of a reference list that is meant.

The reference entries and their shorter forms (first words, initials) stand in a BK-tree under the Levenshtein metric. A value is reduced to its words (legal
forms and places off, abbreviations written out by the words of the list), and each reading is
searched; the triangle inequality prunes the tree and every key within the threshold comes back.
The nearest key wins, of equally near ones a full name before a beginning before initials, over all readings
of the value; a tie between different entries means that none is meant. A reading that is a key itself has
distance 0, so the tree is searched only where no reading is one.

Which entries a form points to, and by which words abbreviations are written out, is found over the whole
list. A list of at most ``MAX_ENTRIES`` entries is broadcast with its tree. A longer one never comes to the
driver: its forms are cut into shards of that size, values meet shards in blocks of bounded size, each block builds
the tree of its shard, and the shards' winners are merged. Both ways give the same rows (tested).

Defined cases: null, blank and ``Unknown`` values and values equal to an entry are not looked up;
two entries of one name are a tie; very long values are read whole; an empty list maps everything to -1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .p01_canonical_text import canonical

MAX_ENTRIES = 20_000
THRESHOLD = 2
CACHE = 1 << 16
FULL, BEGINNING, INITIALS = 0, 1, 2

# Words of legal forms.
LEGAL = {"pte", "ltd", "llp", "limited", "inc", "llc", "plc", "co", "s", "corp", "gmbh"}


def levenshtein(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | down
        d = ((eq & up) + up ^ up) | eq | down
        h_up, h_down = (down | ~(d | up)) & full, up & d
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up, h_down = (h_up << 1 | 1) & full, h_down << 1 & full
        up, down = (h_down | ~(x | h_up)) & full, h_up & x
    return score


class BKTree:
    """Keys under a metric; ``within`` returns every key within a distance."""

    def __init__(self) -> None:
        self.root: tuple[str, dict] | None = None

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while d := levenshtein(key, node[0]):
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, key: str, most: int) -> list[tuple[int, str]]:
        out, open_ = [], [self.root] if self.root else []
        while open_:
            at, children = open_.pop()
            d = levenshtein(key, at)
            if d <= most:
                out.append((d, at))
            open_ += [node for edge, node in children.items() if d - most <= edge <= d + most]
        return sorted(out)


def words(text: str) -> list[str]:
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", canonical(text)[0])
    text = text.replace("&", " and ")
    return re.findall(r"[^\W_]+", re.sub(r"['’]|(?<=\b\w)\.(?=\w\b)", "", text).lower())


def subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def forms(name: str) -> list[tuple[str, int]]:
    """(key, kind) of an entry: its full name, its beginnings, its initials with and without "and"."""
    spoken = words(name)
    w = [x for x in spoken if x != "and"]
    out = [("".join(w[:k]), FULL if k == len(w) else BEGINNING) for k in range(1, len(w) + 1)]
    if len(w) >= 2:
        out += [(k, INITIALS) for k in sorted({"".join(x[0] for x in form) for form in (w, spoken)})]
    return out


def rest_words(name: str) -> list[str]:
    """Words of an entry that abbreviations may stand for."""
    return [x for x in [x for x in words(name) if x != "and"][1:] if len(x) > 3]


def readings(text: str) -> list[list[str]]:
    """Words without legal form: of the whole value, of what stands before a place, and in turned order."""
    text = canonical(text)[0]
    out = [text]
    for mark in (" - ", " / ", "(", ","):
        if mark in text:
            before, _, after = text.rpartition(mark)
            out += [before] + ([after + " " + before] if mark == "," else [])
    seen: list[list[str]] = []
    for t in out:
        w = [x for x in words(t) if x != "and"]
        while w and w[-1] in LEGAL:
            w.pop()
        if w and w not in seen:
            seen.append(w)
    return seen


def writing(word: str, v: str) -> tuple[int, int, str] | None:
    """How well ``word`` may stand for the list's word ``v`` (smaller is better), None if it can't: the word itself, its
    beginning, letters of it in order, or another ending."""
    if word == v:
        return -1, 0, v
    if not word or v[0] != word[0]:
        return None
    if 1 < len(word) < len(v) and subsequence(word, v):
        return (0 if v.startswith(word) else 1), len(v) - len(word), v
    return (2, len(v) - len(word), v) if len(word) >= 6 and v[:5] == word[:5] and abs(len(v) - len(word)) <= 2 else None


def keys_of(read: list[list[str]], write_out) -> tuple[list[str], list[str]]:
    """(keys, initials) that a value may stand under."""
    keys = {k for w in read for k in ("".join(w), "".join([w[0], *map(write_out, w[1:])]))}
    return sorted(keys), sorted({w[0] for w in read if len(w) == 1 and len(w[0]) <= 5})


Best = tuple[int, int, int, int]  # distance, kind, smallest and largest entry


def nearest(found: list[Best]) -> Best | None:
    """The best of several, with all entries that are as good."""
    if not found:
        return None
    d, kind = min(found)[:2]
    same = [f for f in found if f[:2] == (d, kind)]
    return d, kind, min(f[2] for f in same), max(f[3] for f in same)


class Tree:
    """The BK-tree over forms (key, kind, lo, hi); lo and hi differ where entries share a form."""

    def __init__(self, rows: list[tuple[str, int, int, int]]) -> None:
        self.tree, self.at, self.initials = BKTree(), {}, {}
        for key, kind, lo, hi in rows:
            if kind == INITIALS:
                self.initials[key] = (0, INITIALS, lo, hi)
            else:
                self.at[key] = (kind, lo, hi)
                self.tree.add(key)

    def exact(self, keys: list[str], initials: list[str]) -> Best | None:
        return nearest([(0, *self.at[k]) for k in keys if k in self.at] + [self.initials[k] for k in initials if k in self.initials])

    def near(self, key: str, threshold: int) -> Best | None:
        return nearest([(d, *self.at[at]) for d, at in self.tree.within(key, min(threshold, len(key) // 5))])


def entry_forms(entries: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """key, kind, lo, hi over the whole list: full names, initials, and beginnings that are no full name. lo and hi
    differ where several entries share a form: whatever is nearest to it is a tie."""
    udf = F.udf(lambda n: forms(n), "array<struct<key: string, kind: int>>")
    rows = entries.filter(F.col(name_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.inline(udf(F.col(name_column))))
    owned = rows.groupBy("key", "kind").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    full = owned.filter(f"kind = {FULL}").select("key")
    return owned.filter(f"kind <> {BEGINNING}").unionAll(owned.filter(f"kind = {BEGINNING}").join(full, "key", "left_anti"))


def vocabulary(entries: DataFrame, name_column: str) -> DataFrame:
    udf = F.udf(rest_words, "array<string>")
    return entries.filter(F.col(name_column).isNotNull()).select(F.explode(udf(F.col(name_column))).alias("v")).distinct()


def find_entry(df: DataFrame, column: str, entries: DataFrame, id_column: str, name_column: str, out: str, threshold: int = THRESHOLD) -> DataFrame:
    """Add ``out``: the id of the entry that ``column`` means, -1 if none, null for null. With a broadcast list there is no
    shuffle: each task keeps what it has already read of a value."""
    table, known = entry_forms(entries, id_column, name_column), vocabulary(entries, name_column)
    if entries.count() > MAX_ENTRIES:
        return _find_in_shards(df, column, written(table, "forms"), known, out, threshold)
    sc = df.sparkSession.sparkContext
    held = sc.broadcast(([tuple(r) for r in table.orderBy("key", "kind").collect()], sorted(r.v for r in known.collect())))  # at most MAX_ENTRIES names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree, by_letter = Tree(held.value[0]), {}
        for v in held.value[1]:
            by_letter.setdefault(v[0], []).append(v)

        @lru_cache(CACHE)
        def write_out(word: str) -> str:
            return min((w for v in by_letter.get(word[:1], ()) if (w := writing(word, v))), default=(0, 0, word))[2]

        near = lru_cache(CACHE)(lambda key: tree.near(key, threshold))

        @lru_cache(CACHE)
        def find(text: str) -> int:
            keys, initials = keys_of(readings(text), write_out)
            best = tree.exact(keys, initials) or nearest([b for k in keys if (b := near(k))])
            return best[2] if best and best[2] == best[3] else -1

        for values in batches:
            yield pd.Series([None if v is None else find(v) for v in values], dtype="Int64")

    return df.withColumn(out, F.pandas_udf(run, "bigint")(F.col(column)))


def _blocks(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of a block (i, j) in which each row of one meets each of the other with the same
    ``keys``: every block holds about ``MAX_ENTRIES`` rows a side, so no task holds a side."""
    n, m = [max(1, -(-x.count() // MAX_ENTRIES)) for x in (a, b)]
    own = lambda x, k: F.pmod(F.xxhash64(*[c for c in x.columns if c not in keys]), F.lit(k)).cast("int")
    all_of = lambda k: F.explode(F.array(*[F.lit(i) for i in range(k)])) if k <= 1000 else F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return a.withColumn("i", own(a, n)).withColumn("j", all_of(m)), b.withColumn("j", own(b, m)).withColumn("i", all_of(n))


def _find_in_shards(df: DataFrame, column: str, table: DataFrame, known: DataFrame, out: str, threshold: int) -> DataFrame:
    split = F.udf(readings, "array<array<string>>")
    values = written(df.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("read", split("value")), "values")
    # abbreviations: every word of the values against the list's words with its first letter
    used = values.select("value", F.explode(F.array_distinct(F.flatten(F.transform("read", lambda w: F.slice(w, 2, 1 << 30))))).alias("word")).filter("word <> ''")
    letter: Column = F.substr("word", F.lit(1), F.lit(1))
    left, right = _blocks(used.select("word").distinct().withColumn("letter", letter), known.withColumn("letter", F.substr("v", F.lit(1), F.lit(1))), ["letter"])

    def write(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = [(word, *w) for word in a["word"] for v in b["v"] if (w := writing(word, v))]
        return pd.DataFrame(rows, columns=["word", "kind", "more", "v"])

    by = ["letter", "i", "j"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(write, "word string, kind int, more int, v string")
    best = met.groupBy("word").agg(F.min(F.struct("kind", "more", "v")).alias("w")).select("word", "w.v")
    spelled = used.join(best, "word").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("spelled"))
    make = F.udf(lambda read, m: keys_of(read, lambda w: (m or {}).get(w, w)), "struct<keys: array<string>, initials: array<string>>")
    keyed = written(values.join(spelled, "value", "left").withColumn("k", make("read", "spelled")).select("value", "k.keys", "k.initials"), "keys")
    plain, short = keyed.select("value", F.explode("keys").alias("key")), keyed.select("value", F.explode("initials").alias("key"))
    exact = plain.join(table.filter(f"kind <> {INITIALS}"), "key").unionAll(short.join(table.filter(f"kind = {INITIALS}"), "key")).select("value", F.lit(0).alias("d"), "kind", "lo", "hi")
    exact = written(exact, "exact")
    open_ = plain.join(exact.select("value"), "value", "left_anti")
    left, right = _blocks(open_.select("key").distinct(), table.filter(f"kind <> {INITIALS}").withColumnRenamed("key", "at"), [])

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(list(b[["at", "kind", "lo", "hi"]].sort_values("at").itertuples(index=False, name=None)))
        return pd.DataFrame([(k, *best) for k in a["key"] if (best := tree.near(k, threshold))], columns=["key", "d", "kind", "lo", "hi"])

    near = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(search, "key string, d int, kind int, lo bigint, hi bigint")
    found = exact.unionAll(open_.join(near, "key").select("value", "d", "kind", "lo", "hi"))
    won = found.groupBy("value", "d", "kind").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("value").agg(F.min_by(F.struct("lo", "hi"), F.struct("d", "kind")).alias("w"))
    won = won.select(F.col("value").alias("__value"), F.when(F.col("w.lo") == F.col("w.hi"), F.col("w.lo")).otherwise(-1).alias("__id"))
    joined = df.join(won, F.col(column) == F.col("__value"), "left")
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce("__id", F.lit(-1).cast("bigint")))).drop("__value", "__id")


def firms_found(contacts: DataFrame, firm_ref: DataFrame) -> DataFrame:
    """contact_id, firm_id of every contacts row whose firm is given but equals no entry."""
    listed = firm_ref.select(F.col("firm_name").alias("firm")).distinct()  # Spark broadcasts it while it is small
    rows = contacts.select("contact_id", "firm").filter("firm is not null and trim(firm) not in ('', 'Unknown')")
    rows = rows.join(listed, "firm", "left_anti")
    return find_entry(rows, "firm", firm_ref, "firm_id", "firm_name", "firm_id").select("contact_id", "firm_id")
