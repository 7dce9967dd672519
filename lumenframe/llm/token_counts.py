"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Pieces, Scratch, chunked, table

#: Most frequent pre-tokens whose counts every worker holds (none longer than HEAD_CHARS); the others are joined.
HEAD, HEAD_CHARS = 1 << 17, 48
#: Distinct pre-tokens a worker counts before it passes them on.
HELD = 100_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitter(path: str):
    """text -> (number of special tokens, pre-tokens) of a byte-level vocabulary, as the library splits.

    Texts of characters up to U+024F are split by the published pattern; others by the library's own pre-tokenizer, as
    Unicode tables differ by release.
    """
    import public_tokenizers
    import regex
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    find = regex.compile(public_tokenizers.PATTERN).findall
    odd = regex.compile("[^\x00-\x1b\x20-\u024f]").search
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def pieces(text: str) -> list[str]:
        if odd(text):
            return [text[a:b] for _, (a, b) in library(text)]
        return find(text)

    def split(text: str) -> tuple[int, list[str]]:
        if cut is None or not any(s in text for s in special):
            return 0, pieces(text)
        parts = cut.split(text)
        return len(parts) - 1, [p for x in parts if x for p in pieces(x)]

    return split


def vocabulary(docs: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """piece_counts(pretoken, freq, n): every distinct pre-token of docs.text, its corpus frequency and its pieces."""

    def count(batches):
        split = splitter(path)

        def rows(c):
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["pretoken", "freq"])

        held: Counter = Counter()
        for c in chunked(batches):
            for t in c["text"]:
                if t:
                    held.update(split(t)[1])
            if len(held) >= HELD:
                yield rows(held)
                held = Counter()
        if held:
            yield rows(held)

    def encode(batches):
        from tokenizers import Tokenizer

        pieces = Pieces(Tokenizer.from_file(path))
        for b in batches:
            n = [len(pieces(w)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["pretoken", "freq", "n"])

    freq = docs.select("text").mapInArrow(count, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return scratch.save(freq.mapInArrow(encode, "pretoken string, freq long, n long"), "vocabulary")


def frequent(vocab: DataFrame, head: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: those above a frequency that `head` of them at most reach. The frequency is
    found by a histogram of few bins, so no more than these rows leave the tasks."""
    short = vocab.where(F.length("pretoken") <= HEAD_CHARS)
    step = F.floor(F.log2("freq") * 8).cast("int")
    least, n = None, 0
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if (n := n + r.n) > head:
            break
        least = r.step
    return {} if least is None else {r[0]: r[1] for r in short.where(step >= least).select("pretoken", "n").toLocalIterator()}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text).

    Null and empty texts have 0 bytes and tokens. Rows that repeat a doc_id are counted one by one. Special strings
    inside a text are one token each, the library's default. No rows give no rows.

    The most frequent pre-tokens, `head` of them at most and bounded in length, are summed inside the map task, so the shuffled
    join, by pre-token, only meets the others; each of those is rare, so no key is hot.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    vocab = vocabulary(docs, path, scratch)
    known = spark.sparkContext.broadcast(frequent(vocab, head))

    def per_document(batches):
        from pyspark import TaskContext

        split = splitter(path)
        get, seq = known.value.get, TaskContext.get().partitionId() << 33
        kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))]
        for c in chunked(batches):
            out: list[list] = [[] for _ in kinds]
            for i, t in zip(c["doc_id"], c["text"], strict=True):
                n, words, times = 0, [], []
                if t:
                    n, found = split(t)
                    for w, k in Counter(found).items():
                        if (m := get(w)) is None:
                            words.append(w)
                            times.append(k)
                        else:
                            n += m * k
                for o, v in zip(out, (seq, i, len((t or "").encode("utf-8", "surrogatepass")), n, words, times), strict=True):
                    o.append(v)
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, (_, k) in zip(out, kinds, strict=True)], [n for n, _ in kinds])

    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    counted = scratch.save(docs.mapInArrow(per_document, "row long, doc_id long, n_bytes long, n_known long, words array<string>, times array<int>"), "frequencies")
    rest = counted.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("pretoken"), F.col("w.times").alias("k"))
    summed = rest.join(vocab.select("pretoken", "n"), "pretoken").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("n_rest"))
    out = counted.select("row", "doc_id", "n_bytes", "n_known").join(summed, "row", "left")
    n = F.col("n_known") + F.coalesce(F.col("n_rest"), F.lit(0))
    return out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its bytes and tokens."""
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
