"""What problems 3 and 4 share: names as token lists, firms, mailboxes and connected records."""

from __future__ import annotations

import gc
import re
import threading
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard
from ..session import written as write
from .mailboxes import DESKS, LOCAL_BLOCKS, domain_of, local_of, mailbox, same_but_slip, with_kept, within_one_edit
from .p01_canonical_text import PLAIN, canonical
from .p02_formatting_duplicates import complete_address
from .p06_reference_mapping import find_entry

# Forms of address, letters after a name, and words of page furniture.
TITLES = frozenset("mr mrs ms miss dr prof professor mdm madam sir dame rev hon cfp mba chfc fca cfa phd acca cpa clu afp bsc msc jr snr jnr esq".split())
FURNITURE = frozenset(
    "our team contact us get in touch opening hours branch manager find your adviser advisor head office read more senior meet the view profile about book appointment call home learn staff people directory".split()
)


PLAIN_TEXT = re.compile(PLAIN)
CACHE = 1 << 16  # names whose parse a worker remembers
HELD = 0.5  # share of the driver's heap from which on what finished plans hold is given back
EVERY = 3.0  # seconds between two looks at that while a table is written


def settle(spark: SparkSession) -> None:
    """Let the driver give back what finished plans hold; a query here runs dozens of jobs one after another."""
    gc.collect()
    spark._jvm.System.gc()


def outgrown(taken: int, most: int, left: int) -> bool:
    """Has a heap of at most ``most`` bytes taken more than its share, and more than what the last collection left it?"""
    return taken > max(HELD * most, 1.1 * left)


def written(df: DataFrame, label: str) -> DataFrame:
    """As in session, but the driver's heap is given back as it outgrows its share, also while the job runs: left
    alone the JVM lets it grow to its limit, though little in it is alive."""
    spark, over, left = df.sparkSession, threading.Event(), 0

    def look() -> None:
        nonlocal left
        heap = spark._jvm.java.lang.Runtime.getRuntime()
        if outgrown(heap.totalMemory(), heap.maxMemory(), left):
            settle(spark)
            left = heap.totalMemory()

    def watch() -> None:
        while not over.wait(EVERY):
            look()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return write(df, label)
    finally:
        over.set()
        watcher.join()
        look()


def fold(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def parse_name(name: str | None, full: dict[str, str]) -> tuple[str | None, list[str]]:
    """(spelling, tokens): letters and digits as they look, and the folded words without titles and
    apostrophes, short forms replaced by the full name and left out where it stands beside it."""
    if not name:
        return None, []
    text = (name if PLAIN_TEXT.match(name) else canonical(name)[0]).lower()
    spelling = "".join(re.findall(r"[^\W_]+", text))
    words = [w for w in re.findall(r"[^\W_]+", fold(re.sub(r"['’‘ʼ`´]", "", text))) if w not in TITLES]
    if not words or all(w in FURNITURE for w in words):
        return (spelling or None), []
    out: list[str] = []
    for w in (full.get(w, w) for w in words):
        if w not in out:
            out.append(w)
    return spelling, out


def with_names(df: DataFrame, column: str, short_names: DataFrame) -> DataFrame:
    """Add spelling and toks (empty if the text is no name). The list of short forms is a fixed table of
    given names and travels with the function."""
    rows = short_names.select("given", "short_form").filter("given is not null and short_form is not null").orderBy("given").collect()
    full: dict[str, str] = {}
    for r in rows:
        full.setdefault(fold(r.short_form.lower()), fold(r.given.lower()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parse = lru_cache(CACHE)(lambda n: parse_name(n, full))
        for names in batches:
            yield pd.DataFrame([parse(n) for n in names], columns=["spelling", "toks"])

    udf = F.pandas_udf(run, "struct<spelling: string, toks: array<string>>")
    return df.withColumn("__n", udf(F.col(column))).withColumn("spelling", F.col("__n.spelling")).withColumn("toks", F.col("__n.toks")).drop("__n")


def site_of(url: Column) -> Column:
    """Host of a page without its first label where that is a usual one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^(www|sg|m|en|web)\.(?=[^.]+\.)", ""), F.lit(""))


def near_domains(domains: DataFrame) -> DataFrame:
    """domain, other of (domain, n): the domain itself and those one slip away that stand in more addresses, found by
    symmetric deletes over the different domains."""
    keyed = domains.select("domain", "n", F.explode(deletes(F.col("domain"))).alias("k")).select("domain", "n", F.xxhash64("k").alias("k"))
    other = keyed.select(F.col("domain").alias("other"), F.col("n").alias("m"), "k")
    near = keyed.join(other, "k").filter("domain <> other and m >= n").filter(within_one_edit(F.col("domain"), F.col("other")))
    return near.select("domain", "other").distinct().unionAll(domains.select("domain", F.col("domain").alias("other")))


def mailbox_roots(boxes: DataFrame) -> DataFrame:
    """box, root of (box, n): the most frequent address that is the same mailbox but for a slip. An address looks under
    its own domain and under more frequent ones that are a slip away, by what its local part keeps without a block."""
    parts = boxes.select("box", "n", domain_of(F.col("box")).alias("domain"), local_of(F.col("box")).alias("local"))
    domains = written(parts.groupBy("domain").agg(F.sum("n").alias("n")), "domains")
    mine = parts.join(near_domains(domains).filter("domain <> other"), "domain").select("box", "n", F.col("other").alias("domain"), "local").unionAll(parts.select("box", "n", "domain", "local"))
    key = F.xxhash64("domain", "local_j", "local_kept").alias("key")
    wide = with_kept(mine, "local", LOCAL_BLOCKS, True).select("box", "n", key)
    index = with_kept(parts, "local", LOCAL_BLOCKS, False).select(F.col("box").alias("other"), F.col("n").alias("m"), key)
    near = wide.join(index, "key").filter((F.col("box") != F.col("other")) & ((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("box")))))
    near = near.filter(same_but_slip(F.col("box"), F.col("other")))
    best = near.groupBy("box").agg(F.max(F.struct("m", F.col("other").alias("root"))).alias("b")).select("box", "b.root")
    return boxes.join(best, "box", "left").withColumn("root", F.coalesce("root", "box"))


def similar(a: str, b: str) -> float:
    """1 equal, 0.9 one edit or swap (in words of four letters or more) or all but a letter, 0.7 the beginning, 0.5 the initial, else 0."""
    if a == b:
        return 1.0 if len(a) > 1 else 0.5
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= 3 and long.startswith(short):
        return 0.7 if len(long) - len(short) > 1 else 0.9
    if len(long) - len(short) > 1 or len(short) < 4:
        return 0.0
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    if len(long) > len(short):
        return 0.9 if short[i:] == long[i + 1 :] else 0.0
    other = short[i + 1 :] == long[i + 1 :] or (short[i : i + 2] == long[i : i + 2][::-1] and short[i + 2 :] == long[i + 2 :])
    return 0.9 if other else 0.0


def _edges(short: list[str], long: list[str]) -> dict[int, dict[int, float]]:
    """Similarities above 0 of every word of ``short`` to words of ``long``. Words of long lists are compared only
    where they share their first letter, a letter being left out, or the word without one: all others are 0."""
    # an initial in a longer name stands for none of the shorter name's words
    less = len(short) < len(long)
    if len(short) * len(long) <= 64:
        pairs = ((i, j) for i in range(len(short)) for j in range(len(long)))
    else:
        at: dict[str, list[int]] = defaultdict(list)
        for j, y in enumerate(long):
            for k in {y[0] + "*", y, *(y[:n] + y[n + 1 :] for n in range(len(y)))}:
                at[k].append(j)
        pairs = ((i, j) for i, x in enumerate(short) for j in sorted({j for k in {x[0] + "*", x, *(x[:n] + x[n + 1 :] for n in range(len(x)))} for j in at.get(k, ())}))
    out: dict[int, dict[int, float]] = {}
    for i, j in pairs:
        x, y = short[i], long[j]
        if (s := 0.0 if less and len(y) == 1 < len(x) else similar(x, y)) > 0:
            out.setdefault(i, {})[j] = s
    return out


def _best(rows: list[int], edges: dict[int, dict[int, float]]) -> dict[int, int] | None:
    """The assignment of all ``rows`` to different columns with the greatest sum (Hungarian algorithm), None if there is none."""
    columns = sorted({j for i in rows for j in edges[i]})
    if len(columns) < len(rows):
        return None
    if len(rows) <= 3 and len(columns) <= 5:
        made = [(sum(edges[i][j] for i, j in zip(rows, at, strict=True)), at) for at in permutations(columns, len(rows)) if all(j in edges[i] for i, j in zip(rows, at, strict=True))]
        return dict(zip(rows, max(made, key=lambda m: m[0])[1], strict=True)) if made else None
    none, n, m = 1e6, len(rows), len(columns)
    cost = [[1 - edges[i][j] if j in edges[i] else none for j in columns] for i in rows]
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = {rows[owner[j] - 1]: columns[j - 1] for j in range(1, m + 1) if owner[j]}
    return out if all(j in edges[i] for i, j in out.items()) else None


def assign(short: list[str], long: list[str]) -> dict[int, int] | None:
    """Optimal assignment of every word of ``short`` to a word of ``long``, group by group of words that can be
    exchanged; None if a word stays alone."""
    edges = _edges(short, long)
    if len(edges) < len(short):
        return None
    if len(short) <= 3:
        return _best(list(range(len(short))), edges)
    rows_of: dict[int, list[int]] = defaultdict(list)
    for i, to in edges.items():
        for j in to:
            rows_of[j].append(i)
    out, seen = {}, set()
    for i in edges:
        if i in seen:
            continue
        group, open_ = [], [i]
        seen.add(i)
        while open_:
            x = open_.pop()
            group.append(x)
            for j in edges[x]:
                open_ += [y for y in rows_of[j] if y not in seen]
                seen.update(rows_of[j])
        best = _best(sorted(group), edges)
        if best is None:
            return None
        out |= best
    return out


def align(a: list[str], b: list[str]) -> tuple[float, int, str, str]:
    """Optimal assignment of the shorter list's words to different words of the longer: (sum of
    similarities, how many are more than initials, the word of b that an initial of a stands for, the word of a that
    one of b stands for); zeros if a word stays alone."""
    turned = len(a) > len(b)
    short, long = (b, a) if turned else (a, b)
    best = assign(short, long) if len(short) >= 2 else None
    if best is None:
        return 0.0, 0, "", ""
    total, whole, words = 0.0, 0, ["", ""]
    for i, j in best.items():
        x, y = short[i], long[j]
        s = similar(x, y)
        total, whole = total + s, whole + (s > 0.5)
        for side, (mine, theirs) in enumerate(((x, y), (y, x))):
            if len(mine) == 1 < len(theirs) and not words[side]:
                words[side] = theirs
    return (total, whole, words[1], words[0]) if turned else (total, whole, words[0], words[1])


def name_id() -> Column:
    """128 bits for a firm and the words of a name."""
    return F.unhex(F.md5(F.concat_ws("\x01", "firm", F.array_join(F.array_sort("toks"), "\x02"))))


def deletes(t: Column) -> Column:
    """A word of four letters or more with none or one letter taken out; a shorter one as it is."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    return F.when(F.length(t) >= 4, F.array_append(some, t)).otherwise(F.array(t))


def akin_words(words: DataFrame) -> DataFrame:
    """firm, word, akin: the words of a firm that are the same, one edit or swap away (symmetric-delete index over
    the different words) or the beginning of one another."""
    w = words.select("firm", "word")
    keyed = w.filter("length(word) >= 4").select("firm", "word", F.explode(deletes(F.col("word"))).alias("d")).select("firm", "word", F.xxhash64("firm", "d").alias("d"))
    other = keyed.select(F.col("firm").alias("f"), F.col("word").alias("akin"), "d")
    near = keyed.join(other, "d").filter("word < akin and firm = f").filter(within_one_edit(F.col("word"), F.col("akin"))).select("firm", "word", "akin").distinct()
    near = near.unionAll(near.select("firm", F.col("akin").alias("word"), F.col("word").alias("akin")))
    begins = w.filter("length(word) >= 4").select("firm", F.col("word").alias("long"), F.explode(F.transform(F.sequence(F.lit(3), F.length("word") - 1), lambda n: F.substr("word", F.lit(1), n))).alias("word"))
    begins = begins.join(w.filter("length(word) >= 3"), ["firm", "word"]).select("firm", "word", F.col("long").alias("akin"))
    begins = begins.unionAll(begins.select("firm", F.col("akin").alias("word"), F.col("word").alias("akin")))
    return w.withColumn("akin", F.col("word")).unionAll(near).unionAll(begins)


def name_pairs(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(akin words of a firm, pairs). Pairs are a, b, strong, a_word, b_word, a_side, b_side, a_whole, b_whole of names
    (name, firm, toks, side) of one firm that align; words are those that an initial of the name stands for, strong means two
    words or more in common that are no initials, whole is the number of words that are none.

    All words of the shorter of two aligned names have their match. So a name without initials only looks for its rarest
    word in the firm and the words akin to it, never for a common given name; one with initials looks for each of
    its words beside its first initial. Both orders are asked, so the shorter name's question finds the pair.
    """
    whole = F.filter("toks", lambda t: F.length(t) > 1)
    initial = F.try_element_at(F.filter("toks", lambda t: F.length(t) == 1), F.lit(1))
    named = names.withColumn("whole", whole).withColumn("initial", initial)
    long = named.select("name", "firm", "initial", F.explode("whole").alias("word"))
    df = written(long.groupBy("firm", "word").agg(F.count("*").alias("df")), "words")
    akin = written(akin_words(df), "akin")
    rare = long.join(df, ["firm", "word"])
    rarest = rare.filter("initial is null").groupBy("name", "firm").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    asks = rarest.select("name", "firm", "word", F.lit("").alias("beside")).unionAll(long.filter("initial is not null").select("name", "firm", "word", F.col("initial").alias("beside")))
    asks = asks.join(akin, ["firm", "word"]).select(F.col("name").alias("a"), "firm", "akin", "beside", "word")
    asks = asks.join(names.select(F.col("name").alias("a"), F.col("toks").alias("at"), F.col("side").alias("a_side")), "a")
    firsts = F.array_distinct(F.transform(F.filter("toks", lambda u: u != F.col("akin")), lambda u: F.substr(u, F.lit(1), F.lit(1))))
    held = named.select(F.col("name").alias("b"), "firm", F.col("toks").alias("bt"), F.col("side").alias("b_side"), "toks", F.explode("whole").alias("akin"))
    held = held.join(rarest.select(F.col("name").alias("b"), F.col("word").alias("rarest")), "b", "left")
    held = held.select("b", "firm", "bt", "b_side", "akin", "rarest", F.explode(F.array_append(firsts, F.lit(""))).alias("beside"))
    met = asks.join(held, ["firm", "akin", "beside"]).filter("a <> b")
    # where both names ask for these words the pair is kept once
    met = met.filter("a < b or beside <> '' or rarest is null or rarest <> akin").select("a", "b", "at", "bt", "a_side", "b_side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, x, y, s, t in zip(pdf["a"], pdf["b"], pdf["at"], pdf["bt"], pdf["a_side"], pdf["b_side"], strict=True):
                if a > b:
                    a, b, x, y, s, t = b, a, y, x, t, s
                _, whole, aw, bw = align(list(x), list(y))
                if whole:
                    out.append((a, b, whole >= 2, aw, bw, s, t, sum(len(w) > 1 for w in x), sum(len(w) > 1 for w in y)))
            yield pd.DataFrame(out, columns=["a", "b", "strong", "a_word", "b_word", "a_side", "b_side", "a_whole", "b_whole"])

    found = met.mapInPandas(run, "a binary, b binary, strong boolean, a_word string, b_word string, a_side int, b_side int, a_whole int, b_whole int")
    return akin, written(found.dropDuplicates(["a", "b"]), "pairs")


def meets(weak: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unclear of names whose initials meet a word in directed weak pairs (keys, word): do they meet different words?"""
    met = weak.filter("word <> ''").groupBy(*keys).agg(F.min("word").alias("w0"), F.max("word").alias("w1"))
    return met.select(*keys, (F.levenshtein("w0", "w1") > 2).alias("unclear"))


def links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(space, a, b of linked names, names (space, a) that could stand for several persons) of pairs with their space. A
    name with an initial only counts where all full names that it could stand for agree."""
    weak = pairs.filter("not strong")
    weak = weak.select("space", "a", "b", F.col("a_word").alias("word"), F.col("a_whole").alias("whole")).unionAll(weak.select("space", F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_word").alias("word"), F.col("b_whole").alias("whole")))
    met = written(meets(weak, ["space", "a"]), "meets")
    weak = weak.join(met, ["space", "a"], "left").join(met.select("space", F.col("a").alias("b"), F.col("unclear").alias("b_unclear")), ["space", "b"], "left")
    by_word = F.col("word") != ""
    kept = weak.filter((by_word & ~F.col("unclear")) | (~by_word & F.col("unclear").isNull() & F.col("b_unclear").isNull()))
    few = weak.filter("whole < 2 and unclear").select("space", "a").distinct()
    return pairs.filter("strong").select("space", "a", "b").unionAll(kept.select("space", "a", "b")), few


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """rec, person: the same person for all nodes (of an edge) that are connected. In each round a node takes the first of
    itself and its neighbours in an order that is drawn anew, and edges are drawn between what their ends took; those
    within one node go. So most edges are gone after the first round, whatever the shape of the graph, and only what is left
    is read again. Rounds are written tables; in the end the steps of all rounds are followed."""
    def first(c: str, k: int) -> Column:
        return F.struct(F.xxhash64(F.lit(k), c).alias("o"), F.col(c).alias("n"))

    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for k in range(rounds):
        ends = left.select("a", first("b", k).alias("f")).unionAll(left.select(F.col("b").alias("a"), first("a", k).alias("f")))
        taken = ends.groupBy("a").agg(F.min("f").alias("f")).select(F.col("a").alias("rec"), F.least(first("a", k), "f")["n"].alias("person"))
        steps.append(written(taken, "labels"))
        new = left.join(steps[-1].select(F.col("rec").alias("a"), F.col("person").alias("x")), "a").join(steps[-1].select(F.col("rec").alias("b"), F.col("person").alias("y")), "b")
        new = written(new.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left)
        left = new
        if new.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("rec").alias("person"), F.col("person").alias("next")), "person", "left").select("rec", F.coalesce("next", "person").alias("person"))
    return out


def majority(pairs: DataFrame, key: str, value: str, share: float = 0.6) -> DataFrame:
    """key, value where one value has at least ``share`` of the key's rows."""
    n = pairs.filter(f"{key} is not null and {value} is not null").groupBy(key, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(key)
    best = n.withColumn("all", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return best.filter(f"k = 1 and n >= {share} * all").select(key, value)


class People:
    """contacts (contact_id, spelling, toks, firm, root, rec, person) and hits (hit_id, ...) resolved to
    persons within each table. Persons of the two tables are not connected here."""

    def __init__(self, contacts: DataFrame, hits: DataFrame, firm_ref: DataFrame, short_names: DataFrame) -> None:
        c = contacts.select("contact_id", "name", "firm", F.when(complete_address(F.col("email")), mailbox(F.col("email"))).alias("box"))
        c = with_names(c, "name", short_names)
        c = find_entry(c, "firm", firm_ref, "firm_id", "firm_name", "fid")
        other = F.regexp_replace(F.regexp_replace(F.lower("firm"), r"\b(pte|ltd|llp|limited|inc)\b|\([a-z]\)", ""), r"[^\p{L}\p{N}]", "")
        typed = F.when(F.col("fid") >= 0, F.concat(F.lit("f"), F.col("fid"))).when(~other.isin("", "unknown"), F.concat(F.lit("u"), other))
        c = written(c.select("contact_id", "spelling", "toks", "box", typed.alias("typed")), "contacts")
        h = hits.select("hit_id", "nearby_name", mailbox(F.col("email")).alias("box"), F.coalesce("is_role", F.lit(False)).alias("role"), site_of(F.col("source_url")).alias("site"))
        h = written(with_names(h, "nearby_name", short_names).drop("nearby_name"), "hits")

        counts = c.select("box", F.lit(False).alias("role")).unionAll(h.select("box", "role")).filter("box is not null")
        boxes = written(counts.groupBy("box").agg(F.count("*").alias("n"), F.bool_or("role").alias("role")), "boxes")
        roots = mailbox_roots(boxes)
        desk = roots.groupBy("root").agg(F.bool_or("role").alias("role")).withColumn("desk", F.col("role") | local_of(F.col("root")).isin(*DESKS)).select("root", "desk")
        roots = written(roots.select("box", "root").join(desk, "root"), "roots")

        # a site's firm: what contacts with an address of that domain mostly say
        c = c.join(roots, "box", "left")
        c = c.withColumn("domain", domain_of(F.coalesce("root", F.lit(None).cast("string"))))
        self.sites = firm_of = written(majority(c, "domain", "typed").select(F.col("domain").alias("site"), F.col("typed").alias("site_firm")), "sites")
        c = c.join(firm_of.select(F.col("site").alias("domain"), "site_firm"), "domain", "left").withColumn("firm0", F.coalesce("site_firm", "typed"))
        by_box = majority(c, "root", "firm0", 0.5).select("root", F.col("firm0").alias("box_firm"))
        c = c.join(by_box, "root", "left")
        # an unlisted firm is taken as typed only where the mailbox says nothing
        c = c.withColumn("firm", F.coalesce("site_firm", "box_firm", "firm0"))
        c = c.withColumn("root", F.when(~F.col("desk"), F.col("root")))
        h = h.join(roots, "box", "left").filter("not coalesce(desk, false) and not role")
        h = h.join(firm_of, "site", "left").withColumn("firm", F.coalesce("site_firm", F.concat(F.lit("s"), F.col("site"))))
        self.contacts, self.hits = self._rows(c, "contact_id", "c"), self._rows(h, "hit_id", "h")
        self._resolve()

    @staticmethod
    def _rows(df: DataFrame, id_column: str, space: str) -> DataFrame:
        """Rows with their name (null if it has none that can be told apart), and the node of the graph they stand at: the
        mailbox, else the name, else the row itself."""
        rows = df.select(id_column, "spelling", "toks", "firm", "root").withColumn("space", F.lit(space))
        named = F.col("firm").isNotNull() & (F.size("toks") >= 2)
        rows = rows.withColumn("any", F.when(named, name_id())).withColumn("name", F.when(F.exists("toks", lambda t: F.length(t) > 1), F.col("any")))
        node = F.when(F.col("root").isNotNull(), node_of("box", F.col("root"))).when(named, node_of("name", F.col("any"))).otherwise(node_of("row", F.col(id_column).cast("string")))
        return written(rows.withColumn("node", node).drop("any"), f"rows-{space}")

    def _resolve(self) -> None:
        """Persons: connected nodes. Copies of a name or a mailbox are one node, however many rows they have."""
        spaces = {"c": 1, "h": 2}
        rows = [r.filter("name is not null") for r in (self.contacts, self.hits)]
        sides = [r.select("name", "firm", F.array_sort("toks").alias("toks"), F.lit(s).alias("side")) for r, s in zip(rows, spaces.values(), strict=True)]
        self.names = written(sides[0].unionAll(sides[1]).groupBy("name").agg(F.first("firm").alias("firm"), F.first("toks").alias("toks"), F.bit_or("side").alias("side")), "names")
        settle(self.names.sparkSession)
        self.akin, self.pairs = name_pairs(self.names)
        settle(self.names.sparkSession)
        here = F.array_compact(F.array(*[F.when(F.col("a_side").bitwiseAND(k).bitwiseAND(F.col("b_side")) > 0, s) for s, k in spaces.items()]))
        linked, unclear = links(self.pairs.withColumn("space", F.explode(here)))
        edges = linked.select(node_of("name", F.col("a")).alias("a"), node_of("name", F.col("b")).alias("b"))
        # a name that could stand for several persons links nobody, nor do its copies
        at = rows[0].select("space", "name", "root", "node").unionAll(rows[1].select("space", "name", "root", "node")).filter("root is not null").select("space", F.col("name").alias("a"), F.col("node").alias("b")).distinct()
        boxes = at.join(unclear, ["space", "a"], "left_anti").select(node_of("name", F.col("a")).alias("a"), "b")
        persons = components(edges.unionAll(boxes)).withColumnRenamed("rec", "node")
        self.contacts, self.hits = [written(r.join(persons, "node", "left").withColumn("person", F.coalesce("person", "node")).drop("node"), "people") for r in (self.contacts, self.hits)]
        settle(self.names.sparkSession)


def node_of(kind: str, what: Column) -> Column:
    """128 bits for a node of one table (column space)."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.lit(kind), "space", what if kind != "name" else F.hex(what))))
