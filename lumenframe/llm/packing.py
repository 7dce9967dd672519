"""Harmonic packing: pieces of a reciprocal-capacity length fill bins of a fixed count, class by class.

A document is cut into pieces whose lengths are capacity // k. A class is one length; its bins take capacity // length
pieces each, so the place of a piece follows from its rank within the class alone and workers fill bins independently.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE, Pieces, Scratch, chunked, table

#: Lengths above FINE are capacity // k only; up to FINE every length is a class of its own.
FINE = 64
#: Rows of bin starts that are broadcast; with more, they are joined by shuffling.
BROADCAST_ROWS = 200_000


def lengths(capacity: int) -> list[int]:
    return sorted({capacity // k for k in range(1, capacity // FINE + 1)} | set(range(1, min(FINE, capacity) + 1)))


def cutter(capacity: int):
    """n -> lengths of the pieces of a document of n tokens, largest first: whole bins, then at each step the longest
    class that the rest still fills. The rest falls at least quadratically, so there are few pieces."""
    all_lengths = np.array(lengths(capacity))

    @lru_cache(65536)
    def tail(n: int) -> tuple[int, ...]:
        out = []
        while n:
            out.append(int(all_lengths[np.searchsorted(all_lengths, n, "right") - 1]))
            n -= out[-1]
        return tuple(out)

    return lambda n: (capacity,) * (n // capacity) + tail(n % capacity)


class WordIds:
    """Token ids of whole texts by the parts between white space, which no pre-token spans; each is encoded once, then kept.

    Texts with characters outside \\x00-\\x1b and \\x20-\\u024f, or with special strings, go to the library whole, as its
    Unicode tables and rules hold for those.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = re.compile("[^\x00-\x1b\x20-\u024f]").search
        find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        encode = Pieces(self.tok)

        class Ids(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= 2 * CACHE:
                    self.clear()
                self[part] = ids = array("I", [i for w in find(part) for i in encode(w)]).tobytes()
                return ids

        self.ids = Ids()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.odd(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, text.lower().split()))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One per worker process, whatever tasks it runs."""
    return WordIds(path)


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs(doc_id, text).

    Null and empty texts hold the end id alone. Every row is packed, repeated ones and those with a null doc_id too.
    No rows give no rows. Each id lies in exactly one piece.

    Full bins: the rank of a piece within its class is its rank in its map task plus the counts of earlier tasks
    (tasks x classes small rows). What is left over in each class is less than one bin of it, a number bounded by the
    capacity alone; those pieces are packed together, longest first, in one small task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def cut(batches):
        from pyspark import TaskContext

        ids_of, pieces = word_ids(path), cutter(capacity)
        end, task = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
        for c in chunked(batches):
            out: list[list] = [[] for _ in kinds]
            for i, t in zip(c["doc_id"], c["text"], strict=True):
                ids = (ids_of(t) if t else b"") + end
                n, start = len(ids) // 4, 0
                for length in pieces(n):
                    r = ranks.get(length, 0)
                    ranks[length] = r + 1
                    for o, v in zip(out, (i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, task, r), strict=True):
                        o.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, (_, k) in zip(out, kinds, strict=True)], [n for n, _ in kinds])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"
    pieces = scratch.save(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema), "pieces")

    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).withColumn("bins", F.floor(F.col("n") / per_bin))
    ahead = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as classes
    classes = classes.select("length", "bins", F.coalesce(F.sum("bins").over(ahead), F.lit(0)).alias("first"))
    starts = scratch.save(starts.join(F.broadcast(classes), "length"), "starts")
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "task"]).withColumn("r", F.col("earlier") + F.col("rank")).withColumn("bin", F.floor(F.col("r") / per_bin))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked.where(F.col("bin") < F.col("bins")).withColumn("sequence_id", F.col("first") + F.col("bin")).withColumn("offset", (F.col("r") % per_bin) * F.col("length"))

    def rest(_, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        first, room, put = int(df["full_bins"].iloc[0]), [], []
        for n in df["length"]:
            b = next((b for b, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            put.append((first + b, capacity - room[b]))
            room[b] -= n
        df["sequence_id"], df["offset"] = zip(*put, strict=True)
        return df[columns]

    over = classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("full_bins")).scalar()
    left = ranked.where(F.col("bin") >= F.col("bins")).select(F.lit(1).alias("one"), over.alias("full_bins"), *columns[:5])
    last = left.groupBy("one").applyInPandas(rest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.select(*[F.col(c).cast("bigint").alias(c) for c in columns]).unionByName(last)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence."""
    from .token_counts import vocabulary_path

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("word_bpe_49k.json"))
