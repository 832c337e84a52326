"""How each domain forms addresses from names: learned, checked leave-one-out, used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import emails
from ..functions.names import SURNAME_AWARE, SURNAMES, candidates, formats, name_tokens, with_split_name
from ..session import written
from .ranking import global_rank

MIN_CONFIDENCE = 0.70
LONG_NAME = 0.33  # how much less often a long name follows the format
RIVALS = ("given.sur", "allgiven.sur", "givensur", "allgivensur")


def learnable(book: DataFrame, surnames: tuple[str, ...] = SURNAMES) -> DataFrame:
    """id, domain, actual (local part), toks, given, sur of personal addresses: no free mail, no desk."""
    rows = book.withColumn("e", emails.tidy(F.col("email"))).filter(F.contains("e", F.lit("@")))
    rows = rows.select("id", emails.domain(F.col("e")).alias("domain"), emails.local(F.col("e")).alias("actual"), name_tokens(F.col("name")).alias("toks"))
    rows = rows.filter(~emails.is_free(F.col("domain")) & ~emails.is_role(F.col("actual")))
    return with_split_name(rows, "toks", surnames)


def scores(rows: DataFrame) -> DataFrame:
    """domain, pattern, attempts, hits, n. One row per domain and format after map-side combining."""
    n = rows.groupBy("domain").agg(F.count("*").alias("n"))
    got = candidates(rows, "domain", "actual").groupBy("domain", "pattern").agg(F.count("*").alias("attempts"), F.count_if(F.col("local") == F.col("actual")).alias("hits"))
    return got.join(n, "domain")


def eligible() -> Column:
    """Enough names could be built to speak of a house style."""
    return F.col("attempts") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))


def suffix_style(rows: DataFrame) -> DataFrame:
    """domain, suffix_rate: share of names of two tokens or more whose address is the joined tokens (or
    first and last) and up to four letters more."""
    t = F.col("toks")
    joined, ends = F.array_join(t, ""), F.concat(F.try_element_at(t, F.lit(1)), F.try_element_at(t, F.lit(-1)))

    def hit(stem: Column) -> Column:
        return F.startswith("actual", stem) & F.substr("actual", F.length(stem) + 1).rlike("^[a-z]{0,4}$")

    named = rows.filter(F.size(t) >= 2).select("domain", (hit(joined) | ((F.size(t) >= 3) & hit(ends))).alias("hit"))
    return named.groupBy("domain").agg((F.count_if("hit") / F.count("*")).alias("suffix_rate"))


def models(rows: DataFrame) -> DataFrame:
    """domain, pattern, confidence, samples, predictable, runners_up (at most four), suffix_rate."""
    aware = F.col("pattern").isin(*SURNAME_AWARE)
    ranked = scores(rows).filter(eligible()).withColumn("rate", F.col("hits") / F.col("attempts")).withColumn("rank", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("rate"), F.desc(aware), "pattern")))
    # 27 rows per domain at most
    best = ranked.filter("rank <= 5").groupBy("domain").agg(
        F.max(F.when((F.col("rank") == 1) & (F.col("rate") > 0), F.col("pattern"))).alias("pattern"),
        F.max(F.when(F.col("rank") == 1, F.col("rate"))).alias("rate"),
        F.array_sort(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rate") > 0), F.struct("rank", "pattern", "rate")))).alias("r"),
    )
    n = rows.groupBy("domain").agg(F.count("*").alias("samples"))
    out = n.join(best, "domain", "left").join(suffix_style(rows), "domain", "left")
    rate, suffix = F.coalesce("rate", F.lit(0.0)), F.coalesce("suffix_rate", F.lit(0.0))
    odd = (F.col("samples") >= 3) & (suffix >= 0.6) & (suffix > rate)
    return out.select(
        "domain", "pattern", F.when(odd, suffix).otherwise(rate).alias("confidence"), "samples", (~odd).alias("predictable"),
        F.transform("r", lambda s: s["pattern"]).alias("runners_up"), F.round(suffix, 6).alias("suffix_rate"),
    )


def verdict(least: float = MIN_CONFIDENCE) -> Column:
    return (
        F.when(~F.coalesce("predictable", F.lit(False)) & F.col("predictable").isNotNull(), "needs-full-name")
        .when(F.col("pattern").isNull() | (F.coalesce("samples", F.lit(0)) < 2), "insufficient-evidence")
        .when(F.col("confidence") >= least, "predict")
        .otherwise("ambiguous")
    )


def leave_one_out(rows: DataFrame) -> DataFrame:
    """domain, n, correct, accuracy (null under three addresses). For each address the format is chosen
    from the others: group totals less its own part, so nothing is learned again. The totals of a domain are one row
    with an array over the formats (27); each address chooses with array functions, so its formats never
    become rows and nothing is shuffled by address."""
    made = formats(F.col("toks"), F.col("given"), F.col("sur"))
    names = sorted(made)
    hit = F.array(*[F.when(made[k].isNull(), None).otherwise((made[k] == F.col("actual")).cast("int")) for k in names])  # null: can't be built
    own = rows.select("domain", hit.alias("hit"))
    one = own.groupBy("domain").agg(
        F.count("*").alias("n"), F.array(*[F.count(F.col("hit")[i]) for i in range(len(names))]).alias("attempts"), F.array(*[F.coalesce(F.sum(F.col("hit")[i]), F.lit(0)) for i in range(len(names))]).alias("hits")
    )
    left = own.join(one.filter("n >= 3"), "domain")

    def choice(i: int) -> Column:
        mine = F.col("hit")[i]
        a, h = F.col("attempts")[i] - F.when(mine.isNull(), 0).otherwise(1), F.col("hits")[i] - F.coalesce(mine, F.lit(0))
        # best by rate, then surname-aware, then the smaller name
        order = F.struct((h / a).alias("rate"), F.lit(names[i] in SURNAME_AWARE).alias("aware"), F.lit(-i).alias("place"), F.coalesce(mine, F.lit(0)).alias("hit"))
        return F.when(a >= F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 2)), order)

    best = left.select("domain", F.array_max(F.array(*[choice(i) for i in range(len(names))])).alias("c"))
    right = best.groupBy("domain").agg(F.count_if((F.col("c.rate") > 0) & (F.col("c.hit") == 1)).alias("correct"))
    out = one.select("domain", "n").join(right, "domain", "left").withColumn("correct", F.when(F.col("n") >= 3, F.coalesce("correct", F.lit(0))))
    return out.select("domain", "n", "correct", F.round(F.try_divide("correct", "n"), 6).alias("accuracy"))


def report(rows: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Every domain's format with its fit, hold-out accuracy and verdict, placed by number of known addresses."""
    out = models(rows).join(leave_one_out(rows).select("domain", "correct", "accuracy"), "domain", "left").withColumn("verdict", verdict(least))
    return global_rank(out, [F.desc("samples"), F.asc("domain")], "place")


def placed_predictions(predicted: DataFrame) -> DataFrame:
    """Predictions with their place: surest first, then by firm and name."""
    return global_rank(predicted, [F.desc("confidence_pct"), F.asc("firm"), F.asc("name"), F.asc("id")], "place")


def predicted_domains(predicted: DataFrame) -> DataFrame:
    """domain, predictions: the different domains whose mail servers would be looked up."""
    return predicted.groupBy(emails.domain(F.col("predicted_email")).alias("domain")).agg(F.count("*").alias("predictions"))


def pooled(cv: DataFrame) -> DataFrame:
    got = cv.filter("n >= 3").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"))
    return got.withColumn("accuracy", F.round(F.try_divide("correct", "n"), 6))


def firm_domains(book: DataFrame) -> DataFrame:
    """firm, domain: what most of its people use (desks count, free mail does not), first seen on ties."""
    rows = book.withColumn("e", emails.tidy(F.col("email"))).filter(F.contains("e", F.lit("@")) & F.col("firm").isNotNull() & (F.trim("firm") != ""))
    rows = rows.select(F.trim("firm").alias("firm"), emails.domain(F.col("e")).alias("domain"), "id").filter(~emails.is_free(F.col("domain")))
    n = rows.groupBy("firm", "domain").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.groupBy("firm").agg(F.max_by("domain", F.struct("n", (-F.col("first")).alias("f"))).alias("domain"))


def _build(pattern: Column, made: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, local in made.items():
        out = F.when(pattern == name, local).otherwise(out)
    return out


def guesses(book: DataFrame, surnames: tuple[str, ...] = SURNAMES, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Every name without an address: guess, alternatives (up to three), row confidence, verdict and why it
    is not predicted (null if it is)."""
    learned = written(models(learnable(book, surnames)), "formats")
    blank = book.filter(~F.coalesce(F.contains("email", F.lit("@")), F.lit(False)) & F.col("name").isNotNull())
    rows = with_split_name(blank.select("id", "name", F.trim("firm").alias("firm"), name_tokens(F.col("name")).alias("toks")), "toks", surnames)
    rows = rows.join(firm_domains(book), "firm", "left").join(learned, "domain", "left")
    made = formats(F.col("toks"), F.col("given"), F.col("sur"))
    local = F.map_from_arrays(F.array(*[F.lit(k) for k in made]), F.array(*made.values()))
    rows = rows.withColumn("local", local)
    at = F.concat(F.lit("@"), F.col("domain"))
    rows = rows.withColumn("guess", F.concat(F.try_element_at("local", F.col("pattern")), at))
    rival = F.when(F.size("toks") >= 3, F.array(*[F.lit(x) for x in RIVALS])).otherwise(F.array().cast("array<string>"))
    tried = F.concat(F.coalesce("runners_up", F.array().cast("array<string>")), rival)
    others = F.array_distinct(F.filter(F.transform(tried, lambda p: F.concat(F.try_element_at("local", p), at)), lambda e: e.isNotNull() & ((e != F.col("guess")) | F.col("guess").isNull())))
    rows = rows.withColumn("alternatives", F.slice(others, 1, 3)).withColumn("verdict", verdict(least))
    rows = rows.withColumn("row_confidence", F.coalesce("confidence", F.lit(0.0)) * F.when(F.size("toks") <= 2, 1.0).otherwise(LONG_NAME))
    why = (
        F.when(F.col("domain").isNull(), "no known domain for this firm")
        .when(F.col("guess").isNull() & F.col("pattern").isNotNull(), "name too short to apply the format")
        .when(F.col("verdict") != "predict", F.col("verdict"))
        .when(F.col("row_confidence") < least, F.when(F.size("toks") > 2, "multi-part name").otherwise("below confidence threshold"))
    )
    return rows.withColumn("why", why)


def predictions(guessed: DataFrame) -> DataFrame:
    """The predicted addresses with their evidence; every one is marked as unverified."""
    alt = F.nullif(F.array_join(F.slice("alternatives", 1, 2), " | "), F.lit(""))
    return guessed.filter("why is null").select(
        "id", "name", "firm", F.col("guess").alias("predicted_email"), "pattern", F.bround(F.col("row_confidence") * 100, 0).cast("int").alias("confidence_pct"), F.col("samples").alias("evidence"), alt.alias("alternatives"), F.lit("unverified prediction").alias("status")
    )


def needs_manual(guessed: DataFrame) -> DataFrame:
    """Those not predicted, with the reason and up to three candidates."""
    shown = F.slice(F.array_compact(F.concat(F.array("guess"), "alternatives")), 1, 3)
    more = F.when(F.size(shown) > 0, F.concat(F.lit(" (candidates: "), F.array_join(shown, ", "), F.lit(")"))).otherwise("")
    return guessed.filter("why is not null").select("id", "name", "firm", F.when(F.col("domain").isNull(), F.col("why")).otherwise(F.concat("why", more)).alias("why"))
