"""URL filters: longest-match rules, else a ratio of character language models.

Two smoothed variable-order Markov models (orders 0 to 2 interpolated by Witten-Bell
weights, so a context counts as far as it has been seen) are trained on the URLs that the
rules accept and reject.  A URL that no rule fits is judged by the difference of the
log-likelihoods a character; the threshold is calibrated on a held-out part of the ruled URLs.

DataFrame functions only.  The models become one array of ALPHABET**3 differences (32,768
doubles, whatever the input), which the scoring projection reads as a scalar subquery.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and is
judged by the models on the empty string (difference 0); URLs of any length are judged whole; repeated rows are judged alike; an
empty table gives an empty result; if either class has no URL, all differences are 0 and
everything unruled is allowed.  Columns of the input with clashing names are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: URLs are judged in 32 symbols, written as the ASCII characters from "_" on: "_" anything
#: else, "`" start, 26 letters, "{" a digit, then "/", "." and "-".
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABET = 32
START = "``"
#: Sixteenths of the ruled URLs, by hash, that calibrate instead of training.
HELD_OUT = 4
BINS = 400
#: Differences a character are cut to this size for the calibration's histogram.
SPREAD = 4.0


def host_of(url: Column) -> Column:
    host = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(host, LETTERS.upper(), LETTERS), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; longest by host and path together, the first named if equal."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, then in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, F.lit(domain + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(then)).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """A URL in the 32 symbols."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9/.-]", "_")
    return F.translate(plain, "0123456789/.-", "{" * 10 + "|}~")


def code_of(symbol: Column) -> Column:
    return F.ascii(symbol) - ord("_")


def mean_difference(symbols: Column, table: Column) -> Column:
    """Differences of ``table`` a character: a fold whose state is the sum, the count and the last two symbols."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(ALPHABET + 1).alias("context"))
    gram = lambda a, c: a["context"] * ALPHABET + code_of(c)
    step = lambda a, c: F.struct((a["sum"] + F.element_at(table, gram(a, c) + 1)).alias("sum"), (a["n"] + 1).alias("n"), (gram(a, c) % ALPHABET**2).alias("context"))
    return F.when(symbols == "", F.lit(0.0)).otherwise(F.aggregate(F.split(symbols, ""), start, step, lambda a: a["sum"] / a["n"]))


def difference_table(counts: DataFrame) -> DataFrame:
    """One row, ``table``: for every run of three symbols the log-probability of its last one given
    the two before it, under the accepted URLs less that under the rejected ones.

    ``counts``: gram, accepted, rejected (numbers of occurrences).  All of it works on at most
    ALPHABET**3 rows.
    """
    every = counts.sparkSession.range(0, ALPHABET**3, 1, 1).select(F.col("id").cast("int").alias("gram"))
    full = every.join(counts, "gram", "left").select("gram", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("accepted", "rejected")])
    mod, pair = (F.col("gram") % (ALPHABET**2)).alias("_pair"), (F.col("gram") / ALPHABET).cast("int").alias("_context")
    full = full.select("*", mod, pair, (F.col("gram") % ALPHABET).alias("_last"), ((F.col("gram") / ALPHABET).cast("int") % ALPHABET).alias("_middle"))
    for c in ("accepted", "rejected"):
        n = lambda *by, c=c: F.sum(c).over(W.partitionBy(*by))
        whole = n(F.lit(0))
        of_last, of_pair, of_middle, of_context = n("_last"), n("_pair"), n("_middle"), n("_context")
        # kinds of symbols seen after each context
        full = full.withColumns({"_whole": whole, "_of_last": of_last, "_of_pair": of_pair, "_of_middle": of_middle, "_of_context": of_context})
        first = F.row_number().over(W.partitionBy("_pair").orderBy("gram")) == 1
        full = full.withColumn("_new", (first & (F.col("_of_pair") > 0)).cast("int"))
        full = full.withColumns({"_kinds1": F.sum("_new").over(W.partitionBy("_middle")), "_kinds2": F.sum((F.col(c) > 0).cast("int")).over(W.partitionBy("_context"))})
        p0 = (F.col("_of_last") + 1) / (F.col("_whole") + ALPHABET)
        p1 = F.when(F.col("_of_middle") > 0, (F.col("_of_pair") + F.col("_kinds1") * p0) / (F.col("_of_middle") + F.col("_kinds1"))).otherwise(p0)
        p2 = F.when(F.col("_of_context") > 0, (F.col(c) + F.col("_kinds2") * p1) / (F.col("_of_context") + F.col("_kinds2"))).otherwise(p1)
        full = full.withColumn(f"_log_{c}", F.log(p2))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", (F.col("_log_accepted") - F.col("_log_rejected")).alias("d")))), lambda x: x["d"]).alias("table"))


def judge_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, score (difference a character; null where a rule decides), threshold."""
    src = F.col("__url")
    base = pages.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{url}`").cast("string").alias("__url"))
    base = base.withColumns({"__host": host_of(src), "__path": path_of(src)})
    name, verdict = rule_columns(F.col("__host"), F.col("__path"), rules)
    base = base.withColumns({"__rule": name, "__ruled": verdict})

    ruled = base.filter(F.col("__ruled").isNotNull() & src.isNotNull()).select((F.col("__ruled") == "allow").alias("good"), (F.conv(F.substring(F.md5(src.cast("binary")), 1, 1), 16, 10).cast("int") < HELD_OUT).alias("held"), symbols(src).alias("symbols"))
    good = F.col("good").cast("int")
    # the generator keeps the optimizer from computing the symbols again for every gram
    each = ruled.filter("not held and symbols <> ''").select("good", F.concat(F.lit(START), "symbols").alias("whole")).select("*", F.explode(F.sequence(F.lit(1), F.length("whole") - 2)).alias("at"))
    runs = each.select("good", F.substring("whole", F.col("at"), F.lit(3)).alias("run")).groupBy("run").agg(F.sum(good).alias("accepted"), F.sum(1 - good).alias("rejected"))
    part = lambda k: code_of(F.substring("run", k, 1))
    counts = runs.select(((part(1) * ALPHABET + part(2)) * ALPHABET + part(3)).alias("gram"), "accepted", "rejected")
    both = counts.agg(((F.sum("accepted") > 0) & (F.sum("rejected") > 0)).alias("_both"))
    table = difference_table(counts).select(F.when(F.coalesce(both.scalar(), F.lit(False)), F.col("table")).otherwise(F.array_repeat(F.lit(0.0), ALPHABET**3)).alias("table"))

    scored = ruled.filter("held").withColumn("table", table.scalar()).select("good", mean_difference(F.col("symbols"), F.col("table")).alias("score"))
    bins = scored.select("good", F.least(F.greatest(F.floor((F.col("score") + SPREAD) / (2 * SPREAD) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"))
    bins = bins.groupBy("bin").agg(F.sum(F.col("good").cast("double")).alias("g"), F.sum(1 - F.col("good").cast("double")).alias("b"))
    upto, whole = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    # allowing from a bin on: share of accepted URLs below it and of rejected ones not below it
    errors = bins.select("bin", (F.coalesce(F.sum("g").over(upto), F.lit(0.0)) / F.greatest(F.sum("g").over(whole), F.lit(1.0)) + (F.sum("b").over(whole) - F.coalesce(F.sum("b").over(upto), F.lit(0.0))) / F.greatest(F.sum("b").over(whole), F.lit(1.0))).alias("error"), ((F.sum("g").over(whole) > 0) & (F.sum("b").over(whole) > 0)).alias("two"))
    best = errors.agg(F.min(F.struct("error", "bin")).alias("best"), F.max("two").alias("two"))
    threshold = best.select(F.when(F.coalesce("two", F.lit(False)), F.col("best.bin") * (2 * SPREAD / BINS) - SPREAD).otherwise(F.lit(0.0)).alias("threshold"))

    judged = base.withColumns({"table": table.scalar(), "threshold": threshold.scalar()})
    score = F.when(F.col("__ruled").isNull(), mean_difference(symbols(src), F.col("table")))
    judged = judged.withColumn("score", score)
    by_model = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return judged.select(F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__ruled", by_model).alias("verdict"), "score", "threshold")
