"""Substring dedup: merged count-min sketches of all partitions estimate window counts; a second pass groups exactly
the windows estimated repeated. Estimates never fall short, so no repeated window is lost."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RepeatSketch, Scratch, WordHash, chunked, mix, signed, small, table, text_bytes, windows, word_hashes

#: Rows of repeated whole texts (two numbers each) that are broadcast; with more, they are joined by shuffling.
COPIES = 1_000_000


def _windows(texts: list, k: int, cache: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes) of all windows of k words within one text, and how many each text has."""
    h, at = word_hashes([(t or "").encode("utf-8", "surrogatepass").split() for t in texts], cache)
    n = np.diff(at)
    keep = np.zeros(max(len(h) - k + 1, 0), bool)
    for a, m in zip(at[:-1], n, strict=True):
        if m >= k:
            keep[a : a + m - k + 1] = True
    return windows(h, k)[keep], windows(h, k, seed=2)[keep], np.maximum(n - k + 1, 0)


def cut_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs(doc_id, text).

    A word goes if a window of k words covers it whose word sequence also starts in a document with a smaller doc_id;
    windows are those of the input. Words are runs of anything but [\\x20\\x09-\\x0D]; kept ones are joined by one space.
    Null texts and texts of fewer than k words have no windows. Rows with a null doc_id come before and after nothing:
    they neither lose words nor make others lose any. Rows that repeat a doc_id don't affect each other. No rows give
    no rows. Windows are grouped by 96 bits of two independent hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    keyed = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("row"))  # row tells apart rows of one doc_id
    some = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    copies = some.groupBy("row").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("row", "source")
    copies = small(scratch.save(copies, "copies"), COPIES)
    copied = F.coalesce(F.col("doc_id") > F.col("source"), F.lit(False))
    keyed = keyed.join(copies, "row", "left").withColumn("copied", copied).drop("source")
    # a later copy of a whole text loses all its windows, and its windows start in the first copy too
    firsts = keyed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~F.col("copied")).select("doc_id", F.hash("text").alias("row"), "text")
    sketch = RepeatSketch.sized(text_bytes(docs) / 5)

    def count(batches):
        cache = WordHash()
        yield from sketch.partial(_windows(c["text"], k, cache)[0] for c in chunked(batches))

    counted = scratch.save(firsts.select("text").mapInArrow(count, RepeatSketch.schema), "sketches")
    bits = spark.sparkContext.broadcast(sketch.merged(counted))
    scratch.drop(counted)

    def suspects(batches):
        cache = WordHash()
        names = ["h", "g", "doc_id", "row", "at"]
        for c in chunked(batches):
            h, g, n = _windows(c["text"], k, cache)
            hit = np.flatnonzero(sketch.repeated(h, bits.value))
            if not len(hit):
                continue
            ends = np.cumsum(n)
            doc = np.searchsorted(ends, hit, "right")
            ids, at = np.array(c["doc_id"], np.int64)[doc], hit - (ends - n)[doc]
            h, g = h[hit], (g[hit] >> np.uint64(32)).astype(np.uint32)
            # of the rows at hand, those with a smaller doc_id at hand are sure; they go on under a key of their own, at < 0
            order = np.lexsort((ids, g, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
            first = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            sure = np.zeros(len(hit), bool)
            sure[order] = ids[order] > first
            key = np.where(sure, mix(h + mix(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))), h)
            rows = [signed(key), g.view(np.int32), ids, np.array(c["row"], np.int32)[doc], np.where(sure, -1 - at, at).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)

    found = firsts.mapInArrow(suspects, "h long, g int, doc_id long, row int, at int")
    # after the step above a window has few rows, however many documents share it
    group = Window.partitionBy("h", "g")
    again = found.withColumn("first", F.min("doc_id").over(group)).where("at < 0 or doc_id > first")
    runs = again.groupBy("doc_id", "row").agg(F.collect_set(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))).alias("starts"))  # no more than a document has words

    def cut(batches):
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for c in chunked(batches):
            out: list[list] = [[] for _ in names]
            for i, t, starts, copied in zip(c["doc_id"], c["text"], c["starts"], c["copied"], strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if copied and len(words) >= k:
                    kept = []
                elif starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.array(starts)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                for o, v in zip(out, (i, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, x) for o, x in zip(out, kinds, strict=True)], names)

    return keyed.withColumn("row", F.hash("text")).join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "starts", "copied").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those removed, and a digest of the words that stay."""
    out = cut_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > first),
lost AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""
