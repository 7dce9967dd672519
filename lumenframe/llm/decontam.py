"""Benchmark decontamination by a distributed positional inverted index.

Training postings (term, document, position) are stored for the test terms that searches start from; for each test
phrase the lists of its rarest terms are shifted by the terms' offsets and intersected, and what is left is compared
with the phrase word for word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, small, table

#: What lies between words: ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: How many of a phrase's rarest terms have their lists intersected before words are compared.
RAREST = 2
#: Rows of test-side tables that are broadcast, and of keys of documents with candidates; beyond it joins shuffle.
BROADCAST_ROWS, BROADCAST_KEYS = 100_000, 1_000_000


def lower_word(w: Column) -> Column:
    """A-Z lower-cased; the general translation is only needed for words with other letters than ASCII."""
    return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(ascii_lower(w))


def split_words(text: Column) -> Column:
    """The words as they stand, with an empty one at either end if the text begins or ends with a separator."""
    return F.split(F.coalesce(text, F.lit("")), BREAK)


def count_words(split: Column) -> Column:
    n = F.size(split)
    ends = F.when(split[0] == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(split, -1) == ""), 1).otherwise(0)
    return (n - ends).cast("bigint")


def words_of(text: Column) -> Column:
    return F.transform(F.filter(split_words(text), lambda w: w != ""), lower_word)


def phrases(bench: DataFrame, size: int) -> DataFrame:
    """phrase, words, items: each distinct window of `size` words, or whole shorter items, with the items it is in."""
    w = bench.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.size("w") - size, F.lit(0))
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    each = at.select("item_id", F.slice("w", F.col("i") + 1, size).alias("words"))
    one = each.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    return one.select(F.xxhash64("words").alias("phrase"), "words", "items")


def occurrences(docs: DataFrame, found_phrases: DataFrame, scratch: Scratch, slop: int = 0) -> DataFrame:
    """doc, phrase, start, span of every occurrence of the phrases in docs(doc, words); rows of one doc are alike.

    slop 0: the phrase itself. slop s: all terms of the phrase, each at its offset give or take s (proximity); span is
    then the number of document words from the first to the last of them at most.
    """
    terms = found_phrases.select("phrase", F.posexplode("words").alias("off", "term"), F.size("words").alias("size"))
    vocab = small(terms.select("term").distinct(), BROADCAST_ROWS)
    stream = docs.select(F.explode("words").alias("raw")).select(lower_word(F.col("raw")).alias("term"))
    df = scratch.save(stream.join(vocab, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    # a phrase with a term that no document has can't occur
    known = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = Window.partitionBy("phrase").orderBy("df", "term", "off")
    ranked = known.withColumn("r", F.row_number().over(rank)).withColumn("least", F.min("df").over(Window.partitionBy("phrase")))
    starts = scratch.save(ranked.where(F.col("r") <= RAREST).where(F.col("least") > 0).select("phrase", "term", "off", "r", "size"), "starts")
    wanted = small(starts.select("term").distinct(), BROADCAST_ROWS)
    postings = docs.select("doc", F.posexplode("words").alias("pos", "raw")).select("doc", "pos", lower_word(F.col("raw")).alias("term")).join(wanted, "term")
    postings = scratch.save(postings.select("term", "doc", "pos"), "postings")
    # offset-adjusted lists: where a phrase would start by each of its rarest terms
    lists = postings.join(small(starts, BROADCAST_ROWS), "term")
    if slop:
        lists = lists.withColumn("start", F.explode(F.sequence(F.col("pos") - F.col("off") - slop, F.col("pos") - F.col("off") + slop)))
    else:
        lists = lists.withColumn("start", F.col("pos") - F.col("off")).where("start >= 0")
    met = lists.groupBy("doc", "phrase", "start").agg(F.bit_or(F.expr("shiftleft(1, r - 1)")).alias("met"), F.first("size").alias("size"))
    hits = met.where(F.expr(f"met = shiftleft(1, least({RAREST}, size)) - 1"))
    per_doc = scratch.save(hits.groupBy("doc", "phrase").agg(F.collect_set("start").alias("starts")), "candidates")
    with_any = docs.join(small(per_doc.select("doc").distinct(), BROADCAST_KEYS), "doc", "left_semi").dropDuplicates(["doc"])
    near = with_any.join(per_doc, "doc").join(small(found_phrases.select("phrase", F.col("words").alias("p")), BROADCAST_ROWS), "phrase")
    near = near.select("doc", "phrase", F.transform("words", lower_word).alias("words"), "p", F.explode("starts").alias("start"))
    n = F.size("p")
    if slop == 0:
        same = F.slice("words", F.col("start") + 1, n) == F.col("p")
    else:
        same = F.expr(f"forall(transform(p, (x, o) -> array_contains(slice(words, greatest(start + o - {slop}, 0) + 1, greatest(start + o + {slop} + 1 - greatest(start + o - {slop}, 0), 0)), x)), y -> y)")
    return near.where(same).select("doc", "phrase", (F.col("start") - slop).alias("start"), (n + 2 * slop).alias("span"))


def contamination(docs: DataFrame, bench: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, text, n_words, n_hit, items, contaminated for every row of docs(doc_id, text) against bench(item_id, text).

    n_hit counts the words inside occurrences of test windows of `size` words (whole items if shorter); items are the
    ids, as strings in order, of items with a window that occurs. With slop, each term may lie up to that many words off its place, and the words
    inside are all those in which a term of the window was allowed. Null texts have no words; items without words have
    no windows. Repeated rows are judged one by one; rows with a null doc_id are judged like any other. Columns of docs
    other than those two are left alone. Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    key = F.struct(F.xxhash64(F.coalesce("text", F.lit("")), F.length("text")).alias("x"), F.hash("text").alias("m"))  # 96 bits
    keyed = docs.select("doc_id", "text", key.alias("doc"))
    words = keyed.select("doc", split_words(F.col("text")).alias("words"))
    found = scratch.save(phrases(bench, size), "phrases")
    hits = occurrences(words, found, scratch, slop)
    hits = scratch.save(hits.join(small(found.select("phrase", "items"), BROADCAST_ROWS), "phrase").select("doc", "start", "span", "items"), "hits")
    spans = hits.groupBy("doc").agg(F.collect_set(F.struct("start", "span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("items", lambda i: i.cast("string")))))).alias("items"))
    # words lie from `lead` on, after the empty one at the beginning if there is one
    inside = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(F.greatest(s["start"], F.col("lead")), F.least(s["start"] + s["span"], F.col("n_words").cast("int") + F.col("lead")) - 1)))))
    spans = spans.withColumnRenamed("doc", "hit_doc")
    split = split_words(F.col("text"))
    out = keyed.withColumn("n_words", count_words(split)).withColumn("lead", F.when(split[0] == "", 1).otherwise(0)).join(spans, F.col("doc") == F.col("hit_doc"), "left")
    n_hit = F.when(F.col("spans").isNull(), F.lit(0)).otherwise(inside).cast("bigint")
    return out.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those in passages of the benchmark, and a digest of the items they are of."""
    out = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
