"""Grace hash deduplication: records are partitioned to spill files, recursively, until a bucket fits an
open-addressing table that compares complete content."""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunked, table

#: Bytes of distinct content a table holds; what comes beyond is spilled.
TABLE_BYTES = 48 << 20
FANOUT_BITS = 4
IDS_PER_ROW = 128


class OpenTable:
    """Open addressing with linear probing; content is compared in full, the hash only picks the slot."""

    def __init__(self, limit: int):
        self.slots = array("q", [-1]) * 1024
        self.hashes, self.content, self.items = array("Q"), [], []
        self.bytes, self.limit = 0, limit

    def find(self, h: int, content: bytes) -> int:
        """Index of the entry with this content, or ~slot of the free slot."""
        mask, slots = len(self.slots) - 1, self.slots
        i = h & mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.content[e] == content:
                return e
            i = (i + 1) & mask
        return ~i

    def add(self, free: int, h: int, content: bytes, item) -> None:
        self.slots[~free] = len(self.content)
        self.hashes.append(h)
        self.content.append(content)
        self.items.append(item)
        self.bytes += len(content) + 64
        if len(self.content) * 10 > len(self.slots) * 7:
            self.slots = array("q", [-1]) * (len(self.slots) * 2)
            mask = len(self.slots) - 1
            for e, x in enumerate(self.hashes):
                i = x & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = e

    def full(self) -> bool:
        return self.bytes >= self.limit


def grace(records: Iterator[tuple[int, bytes, object]], start, fold, limit: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[int, bytes, object]]:
    """Yield (hash, content, item) once per distinct content of `records` (hash, content, value).

    The first value of a content goes through start(value), each further one through fold(item, value). Once the table
    holds `limit` bytes, records it doesn't hold go to 2**FANOUT_BITS spill files by the next bits of their hash, and
    each file is treated the same way. Every pass takes at least one content out, so equal hashes end as well.
    """
    held, files, folder = OpenTable(limit), None, None
    try:
        for h, content, value in records:
            e = held.find(h, content)
            if e >= 0:
                held.items[e] = fold(held.items[e], value)
            elif not held.full() or not held.content:
                held.add(e, h, content, start(value))
            else:
                if files is None:
                    folder = tempfile.mkdtemp(prefix="grace-")
                    files = [open(f"{folder}/{i}", "wb", buffering=1 << 16) for i in range(1 << FANOUT_BITS)]
                pickle.dump((h, content, value), files[(h >> (60 - FANOUT_BITS * (level % 14))) & (len(files) - 1)], 5)
        yield from zip(held.hashes, held.content, held.items, strict=True)
        held = None
        for f in files or ():
            f.close()

            def back(path=f.name):
                with open(path, "rb") as g:
                    while True:
                        try:
                            yield pickle.load(g)
                        except EOFError:
                            return

            yield from grace(back(), start, fold, limit, level + 1)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


WS = b" \t\n\x0b\x0c\r"


def normal(text: str | None) -> bytes:
    """UTF-8 of the text with each run of [\\x20\\x09-\\x0D] replaced by one space; null as empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return b
    words = b.split()
    if not words:
        return b" "
    return (b" " if b[0] in WS else b"") + b" ".join(words) + (b" " if b[-1] in WS else b"")


def _min(a, b):
    return b if a is None or (b is not None and b < a) else a


def dedup(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Texts are equal if they are the same after normal(). Of equal texts the row with the smallest doc_id stays; rows
    with null doc_id come last (keep_id is null if a group has no other). Null texts count as empty. Rows that repeat a
    doc_id with the same text are one document and are kept or dropped alike. No rows give no rows.

    1. Each map task folds its own rows, so a text goes on at most once per task however many copies it has.
    2. Distinct contents are shuffled by hash and each partition is folded the same way.
    3. Document ids, in rows of at most IDS_PER_ROW, are joined to their group's result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")

    def local(batches):
        task = TaskContext.get().partitionId() << 33
        cols = ["gid", "hash", "content", "min_id", "n", "ids"]

        def records():
            for c in chunked(batches):
                for i, t in zip(c["doc_id"], c["text"], strict=True):
                    b = normal(t)
                    yield xxhash.xxh3_64_intdigest(b), b, i

        def start(i):
            return [i] if i is None else array("q", [i])

        def fold(ids, i):
            if i is None and not isinstance(ids, list):
                ids = list(ids)
            ids.append(i)
            return ids

        def rows(out):
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], cols)

        out, size = [], 0
        for g, (h, content, ids) in enumerate(grace(records(), start, fold, limit)):
            least = min((i for i in ids if i is not None), default=None)
            h -= (h >> 63) << 64
            for k in range(0, len(ids), IDS_PER_ROW):
                out.append((task + g, h, None if k else content, least, len(ids), list(ids[k : k + IDS_PER_ROW])))
            size += len(content) + 8 * len(ids)
            if size > 1 << 22:
                yield rows(out)
                out, size = [], 0
        if out:
            yield rows(out)

    groups = scratch.save(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(local, "gid long, hash long, content binary, min_id long, n long, ids array<long>"), "local")

    def total(batches):
        def records():
            for b in batches:
                for g, h, content, least, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    yield h & (1 << 64) - 1, content, (g, least, n)

        def fold(a, b):
            a.append(b)
            return a

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["gid", "keep_id", "group_size", "text_sha256"])

        out = []
        for _, content, parts in grace(records(), lambda v: [v], fold, limit):
            keep = None
            for _, least, _ in parts:
                keep = _min(keep, least)
            sha = hashlib.sha256(content).hexdigest()
            n = sum(p[2] for p in parts)
            out += [(g, keep, n, sha) for g, _, _ in parts]
            if len(out) > 20_000:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    distinct = groups.where(F.col("content").isNotNull()).select("gid", "hash", "content", "min_id", "n")
    found = distinct.repartition("hash").mapInArrow(total, "gid long, keep_id long, group_size long, text_sha256 string")
    out = groups.select("gid", "ids").join(found, "gid").select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""
