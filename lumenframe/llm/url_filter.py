"""URL filter: longest-match host and path rules, and for other URLs the ratio of two character language models.

Both models are variable-order Markov models: a character's probability after its context of up to ORDER characters is
interpolated from the longest context to the shortest by the counts each has. They are trained on the URLs that the rules
allow and block; a URL's verdict is its log-likelihood difference per character against a threshold calibrated on
rule-decided URLs kept out of training. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 3
#: Weight of the shorter context's estimate, in observations.
ALPHA = 2.0
#: Characters besides a-z that the models tell apart; digits count as 0 and all others as *.
SIGNS = "0./-_?&=%:~+#"
ALPHABET = 26 + len(SIGNS) + 3  # and *, ^ (before the start), $ (the end)
#: The scores' unit, so that sums are exact in any order.
UNIT = 1 << 20
#: Every CALIBRATION-th rule-decided URL, by CRC-32, is kept for the threshold.
CALIBRATION = 5
#: Model rows that are broadcast; there can be ALPHABET ** (ORDER + 1) at most.
BROADCAST_ROWS = 300_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):  # later ones win
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """What the models read: the URL after ://, lower-cased, in ALPHABET, with a $ behind."""
    rest = ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:.*?://)?(.*)$", 1))
    return F.concat(F.regexp_replace(F.regexp_replace(rest, r"[0-9]", "0"), r"[^a-z0./\-_?&=%:~+#]", "*"), F.lit("$"))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of f, as gram: the character behind its ORDER predecessors."""
    at = F.explode(F.sequence(F.lit(1), F.length("f"))).alias("at")
    return urls.select(*keep, at, F.concat(F.lit("^" * ORDER), F.col("f")).alias("g")).select(*keep, F.expr(f"substring(g, at, {ORDER + 1})").alias("gram"))


def model(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, weight): log-likelihood difference in UNITs for every gram of urls(f, good, bad); good and bad count the
    training URLs that read f. The table is bounded by the alphabet and the order, not by the URLs."""
    n = scratch.save(grams(urls, "good", "bad").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")
    # k characters: the context's k - 1 and the one it precedes
    of = n.select("gram", "good", "bad", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k")).withColumn("s", F.expr("right(gram, k)"))
    own = scratch.save(of.groupBy("k", "s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "suffixes")
    own = own.withColumn("c", F.expr("left(s, k - 1)"))
    ctx = own.groupBy("k", "c").agg(F.sum("good").alias("goodc"), F.sum("bad").alias("badc"))
    counts = scratch.save(own.join(ctx, ["k", "c"]).select("k", "s", "good", "goodc", "bad", "badc"), "counts")
    each = of.select("gram", "k", "s").join(counts, ["k", "s"]).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "good", "goodc", "bad", "badc"))).alias("of"))
    step = lambda c: lambda p, x: (x[c] + ALPHA * p) / (x[f"{c}c"] + ALPHA)
    p = {c: F.aggregate("of", F.lit(1.0 / ALPHABET), step(c)) for c in ("good", "bad")}
    return scratch.save(each.select("gram", F.round((F.log(p["good"]) - F.log(p["bad"])) * UNIT).cast("bigint").alias("weight")), "model")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages(page_id, url).

    Null and empty URLs have an empty host and path and are judged by the models like any other. If the rules decide no
    URL one way or the other, there is nothing to learn: other URLs are allowed, with score null. Rows are judged one by
    one, null and repeated page_ids too; other columns are left alone. No rows give no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), folded(F.col("url")).alias("f"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("decided"))
    held = F.crc32("f") % CALIBRATION == 0
    of = lambda v, part: F.sum(F.when((F.col("decided") == v) & part, 1).otherwise(0)).alias
    urls = rows.groupBy("f").agg(of("allow", ~held)("good"), of("block", ~held)("bad"), of("allow", held)("cal_good"), of("block", held)("cal_bad"))
    urls = scratch.save(urls, "urls")
    good, bad = urls.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    weights = model(urls, scratch)
    if weights.count() <= BROADCAST_ROWS:
        weights = F.broadcast(weights)
    summed = grams(urls, "f").join(weights, "gram").groupBy("f").agg(F.sum("weight").alias("total"))
    scored = scratch.save(urls.join(summed, "f").withColumn("score", F.col("total") / F.length("f") / UNIT), "scores")
    cut = threshold(scored)
    out = rows.join(scored.select("f", "score"), "f")
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")


def threshold(scored: DataFrame) -> float:
    """The score, in hundredths, that best balances the shares of calibration URLs judged right; nearest 0 if several
    do. There are no more candidates than hundredths between the largest and smallest log ratio of one character."""
    most = math.ceil(100 * math.log(ALPHABET * 1e12))
    step = F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("score") * 100)))
    bins = scored.where("cal_good + cal_bad > 0").groupBy(step.alias("at")).agg(F.sum("cal_good").alias("g"), F.sum("cal_bad").alias("b"))
    every = Window.partitionBy()
    below = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("at", (F.sum("g").over(every) - F.coalesce(F.sum("g").over(below), F.lit(0))).alias("g"), F.coalesce(F.sum("b").over(below), F.lit(0)).alias("b"), F.sum("g").over(every).alias("gs"), F.sum("b").over(every).alias("bs"))
    # half way from the hundredth before, so that the gap between the two kinds is shared
    bins = bins.withColumn("at", (F.col("at") + F.coalesce(F.lag("at").over(Window.orderBy("at")) + 1, F.col("at"))) / 2)
    best = bins.where("gs > 0 and bs > 0").orderBy((F.col("g") * F.col("bs") + F.col("b") * F.col("gs")).desc(), F.abs("at"), "at").select("at").first()
    return best[0] / 100 if best else 0.0


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return judged(table(spark, sf_dir, "pages", "page_id", "url"))
