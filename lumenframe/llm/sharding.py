"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

RACK, REGION = 4, 8  # shards in a full rack and in a full region
BITS = 48


def hash48(*parts: Column | str) -> Column:
    """A 48-bit number from the MD5 of the parts joined by colons."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 12), 16, 10).cast("bigint")


def tree(weights: Sequence[float], rack: int = RACK, region: int = REGION) -> dict:
    """{region: {rack: {shard: weight}}}; shards fill racks, and racks regions, in order."""
    out: dict = {}
    for i, w in enumerate(weights):
        out.setdefault(i // region, {}).setdefault(i // rack, {})[i] = w
    return out


def _total(node) -> float:
    return sum(map(_total, node.values())) if isinstance(node, dict) else node


def _draw(key: Column, level: str, children: dict) -> Column:
    """The child with the least exponential draw -ln(u) / weight; u depends on the key and the child's own name only."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct((-F.log((hash48(f"{level}{k}", key) + 1) / F.lit(float(1 << BITS))) / F.lit(float(_total(c)))).alias("d"), F.lit(k).alias("k")) for k, c in children.items()]
    return F.array_min(F.array(*draws))["k"]


def _among(picked: Column, branches: dict[int, Column]) -> Column:
    out = None
    for k, c in branches.items():
        out = F.when(picked == k, c) if out is None else out.when(picked == k, c)
    return out


def with_shard(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """df with the shard of each row, decided by the key and the weights alone.

    A node's draw depends on the key, the node's name and its total weight. Changing weights moves rows only between
    subtrees whose weights changed; a new shard that opens a region of its own takes rows into itself alone. Key null
    counts as the text "null". Weights must be positive. Every level is an expression over one row: no shuffle.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    t = tree(weights)
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    df = df.withColumn("_region", _draw(k, "g", t))
    df = df.withColumn("_rack", _among(F.col("_region"), {g: _draw(k, "r", racks) for g, racks in t.items()}))
    df = df.withColumn(out, _among(F.col("_rack"), {r: _draw(k, "s", leaves) for racks in t.values() for r, leaves in racks.items()}))
    return df.withColumn(out, F.col(out).cast("int")).drop("_region", "_rack")


def with_slot(df: DataFrame, shard: str, order: Sequence[str], key: str, slice_rows: int = 4096) -> DataFrame:
    """df with `slot`: gapless from 0 within each shard, in the order of a hash of the key and the `order` columns, then of
    these columns. Rows that are alike in all of them may change places.

    Rows are ranked within slices of a shard's hash range (about slice_rows rows each) and slices start where counts
    of the earlier ones end, so no task holds a shard.
    """
    n = df.select(shard).count()
    shards = 24 if n == 0 else max(1, df.select(shard).distinct().count())
    parts = max(1, -(-n // (shards * slice_rows)))
    # equal keys are told apart by the other columns, so a repeated one does not fill a slice
    h = hash48("slot", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in dict.fromkeys([key, *order])])
    df = df.withColumn("_h", h).withColumn("_slice", F.floor(F.col("_h") * F.lit(parts) / F.lit(1 << BITS)))
    counts = df.groupBy(shard, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(shard, "_slice").orderBy("_h", *[F.col(c).asc_nulls_first() for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(w) - 1)
    return ranked.join(starts, [shard, "_slice"]).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("bigint")).drop("_h", "_slice", "_rank", "_start")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: UTF-8 bytes of the text (null: none) plus 8. Rows with a null doc_id share one key. Repeated rows get slots
    of their own. An empty table gives none. The text is read once for its size and checksum and never shuffled.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"))
    df = with_shard(df, "doc_id", [1.0] * shards)
    df = with_shard(df, "doc_id", [1.0] * (shards + 1), "grown_shard")
    df = Scratch(docs.sparkSession, "sharding").save(df, "drawn")  # counted and ranked below
    df = with_slot(df, "shard", ["doc_id", "size", "text_crc32"], "doc_id")
    return df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, its slot there and its shard among one more."""
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
