"""N-gram Jaccard join with adaptive multi-match prefixes.

A set of n shingles that overlaps another in at least o = ceil(t * n) of its elements shares l of them within both
sets' first n - o + l elements of a common order. Each document picks the l of least estimated cost: a longer prefix
meets more postings, but a candidate must then share l prefix tokens before it is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CountSketch, RepeatSketch, Scratch, WordHash, chunked, join_groups, signed, table, text_bytes, windows, word_hashes
from .components import linked

#: Longest multi-match, and the cost of verifying a candidate in units of reading a posting.
LONGEST, VERIFY = 4, 16.0
#: 64-bit words of a set's parities.
WORDS = 8


def shingle_sets(texts: list, k: int, cache: WordHash) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of k words; of fewer words, one for them all."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    h, at = word_hashes(words, cache)
    w = windows(h, k)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        elif b > a:
            out.append(windows(h[a:b], int(b - a), seed=100 + int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """A set's number of elements in each of 64 * WORDS cells, modulo 2, as bits. Two sets differ in at least as many
    elements as their parities do in bits."""
    odd = np.bincount((s % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(n: int, percent: int, freq: np.ndarray) -> tuple[int, int]:
    """(l, prefix length) for a set of n elements in order, whose estimated frequencies are freq.

    By l candidates number at most sum(freq) / l over the prefix, as each is met l times.
    """
    need = -(-percent * n // 100)
    met = np.cumsum(np.maximum(freq - 1.0, 0.0))
    best = min(range(1, min(LONGEST, need) + 1), key=lambda m: met[n - need + m - 1] * (1 + VERIFY / m))
    return best, n - need + best


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| of their shingle sets; component_id is the smallest
    doc_id reachable by links. Sets are compared by 64-bit hashes of their shingles. Texts that are null or without
    words have no shingles and link with nothing. Rows with a null doc_id keep it, take part in links and give no id
    (component_id is null if no member has one). Repeated rows are equal sets. No rows give no rows.

    Equal sets are collapsed first. Shingles that a sketch of all documents shows to occur once can't be shared; they
    come first in the order and have no postings, so a document without near copies has next to none. Very frequent
    ones, by a second sketch, come last.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    sketch = RepeatSketch.sized(text_bytes(docs) / 5)

    def count(batches):
        cache, hot = WordHash(), CountSketch()

        def sets():
            for c in chunked(batches):
                h = np.concatenate(shingle_sets(c["text"], k, cache))
                hot.add(h)
                yield h

        yield from sketch.partial(sets())
        yield hot.rows()

    counted = scratch.save(docs.select("text").mapInArrow(count, RepeatSketch.schema), "sketches")
    bits = spark.sparkContext.broadcast(sketch.merged(counted.where("chunk >= 0")))
    often = spark.sparkContext.broadcast(CountSketch.merged(counted.where("chunk < 0")))
    scratch.drop(counted)

    def index(batches):
        cache = WordHash()
        names = ["doc_id", "n_shingles", "sig", "l", "share", "odd", "tokens", "hashes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float32(), *[pa.list_(pa.int64())] * 3]
        for c in chunked(batches):
            out: list[list] = [[] for _ in names]
            sets = shingle_sets(c["text"], k, cache)
            all_h = np.concatenate(sets)
            again, freq = sketch.repeated(all_h, bits.value), often.value[CountSketch.cells(all_h)].astype(np.float64)
            freq = np.where(again, np.maximum(freq, 2.0), 1.0)
            at = 0
            for i, s in zip(c["doc_id"], sets, strict=True):
                n = len(s)
                f = freq[at : at + n]
                at += n
                sig, best, share, odd, tokens, hashes = None, None, None, None, None, None
                if n:
                    sig = xxhash.xxh3_64_intdigest(s.tobytes())
                    sig -= (sig >> 63) << 64
                    by = np.lexsort((s, f))
                    best, length = prefix(n, percent, f[by])
                    taken = by[:length]
                    taken = taken[f[taken] > 1]
                    if len(taken) >= best:
                        tokens, hashes, share, odd = signed(s[taken]), signed(s), float((f > 1).mean()), parities(s)
                for o, v in zip(out, (i, n, sig, best, share, odd, tokens, hashes), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names)

    sets = scratch.save(docs.mapInArrow(index, "doc_id long, n_shingles long, sig long, l int, share float, odd array<long>, tokens array<long>, hashes array<long>"), "sets")
    distinct = scratch.save(sets.where(F.col("tokens").isNotNull()).dropDuplicates(["sig"]).select("sig", "n_shingles", "l", "share", "odd", "tokens", "hashes"), "distinct")
    value = F.struct(F.col("n_shingles").alias("n"), "l", *[F.col("odd")[i].alias(f"odd{i}") for i in range(WORDS)])
    postings = distinct.select(F.explode("tokens").alias("key"), F.col("sig").alias("id"), value.alias("v"), F.col("share").alias("central"))

    def fits(x, y):
        # linked sets differ in at most (100 - percent) / (100 + percent) of their elements, and parities in no more bits
        differ = sum(F.bit_count(x[f"odd{i}"].bitwiseXOR(y[f"odd{i}"])) for i in range(WORDS))
        return (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & ((100 + percent) * differ <= (100 - percent) * (x["n"] + y["n"]))

    def check(pairs):
        for s in "ab":
            pairs = pairs.join(distinct.select(F.col("sig").alias(s), F.col("hashes").alias(f"h{s}")), s)
        both = F.size(F.array_intersect("ha", "hb"))
        return pairs.where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")

    bits.destroy()
    often.destroy()
    scratch.sweep()
    comp = linked(postings, check, scratch, fits, enough=lambda x, y: F.least(x["l"], y["l"]))
    rows = scratch.save(sets.select("doc_id", "n_shingles", "sig"), "rows")
    # one row for each signature, then for each component; joined to all rows, of which one group may hold a third
    same = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    if comp is not None:
        members = scratch.save(same.join(comp.withColumnRenamed("id", "sig"), "sig", "left"), "signatures")
        roots = members.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("root_least"), F.count(F.lit(1)).alias("n"))
        found = join_groups(members, scratch.save(roots, "roots"), "component")
        same = found.select("sig", "n", F.coalesce("root_least", "least").alias("least"))
    same = scratch.save(same, "classes")
    scratch.keep(rows, same)
    out = join_groups(rows, same, "sig")
    return out.select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and the smallest doc_id it is linked with."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
