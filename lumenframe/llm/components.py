"""Connected components, and the components of links that are searched by shared keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in edges(a, b): the smallest id it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014) on tables in the shared folder; edges stay
    linear in number and no neighbourhood is ever gathered into one row.
    """
    both = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.save(both(edges), "edges")
    mark = _mark(e)
    while mark[0]:
        ways = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = both(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = scratch.save(both(small), "edges")
        if (now := _mark(new)) == mark:
            e = new
            break
        scratch.drop(e)
        e, mark = new, now
    ids = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def linked(postings: DataFrame, check: Callable[[DataFrame], DataFrame], scratch: Scratch, fits: Callable[[Column, Column], Column], enough: Callable[[Column, Column], Column] | None = None, rounds: int = 4) -> DataFrame | None:
    """(id, component) of ids that are linked with others; None if no key is shared.

    postings(key, id, v, central): two ids may be linked only if they share keys and fits(v, v) holds of their values.
    check(pairs(a, b)) returns the linked ones of the given pairs. enough(v, v): optional least number of shared keys,
    for the last step. postings is read once, dealt by key in one shuffle that finds shared keys and members at once.

    First some rounds in which each key has one member, the most central or one of a component drawn by a hash, checked
    against its members of other components: a large group of like items falls together without pairs within it, and
    counts as one when the next is drawn. Then every
    remaining pair that shares a key across two components is checked. A pair within a component needs no check, so no
    link between components is lost. Pairs are never formed within a component: in the last step the members of a key
    outside its largest component meet the others.
    """
    def dealt(rows, r):
        """Rows of keys that several components share; from them `hub`, the member of round r that a row fits."""
        w = Window.partitionBy("key")
        out = rows.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)})
        if r < rounds:
            order = F.struct((-F.col("central")).alias("c"), F.xxhash64("id", F.lit(r)).alias("x")) if r == 0 else F.struct(F.xxhash64("comp", F.lit(r)).alias("c"), F.xxhash64("id", F.lit(r)).alias("x"))
            out = out.withColumn("h", F.min_by(F.struct("id", "v", "comp"), order).over(w))
            out = out.withColumn("hub", F.when((F.col("comp") != F.col("h.comp")) & fits(F.col("v"), F.col("h.v")), F.col("h.id"))).drop("h")
        return scratch.save(out.where("lo < hi").drop("lo", "hi"), "members")

    p = now = dealt(postings.withColumn("comp", F.col("id")), 0)
    if p.isEmpty():
        return None
    scratch.sweep()
    comp, links, tried = None, None, None

    def current(r):
        if comp is None:
            return dealt(p.drop("hub"), r)
        # keys that components still share are told by keys and ids alone, as the other columns would weigh twice on disk
        now = comp.withColumnRenamed("component", "comp")
        bare = p.select("key", "id").join(now, "id", "left").select("key", F.coalesce("comp", "id").alias("comp"))
        split = scratch.save(bare.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "split")
        scratch.sweep()
        left = p.select("key", "id", "v", "central").join(split, "key").join(now, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        out = dealt(left, r)
        scratch.drop(split)
        return out

    def learn(pairs):
        nonlocal comp, links
        found = scratch.save(check(pairs), "links")
        if found.isEmpty():
            return
        links = found if links is None else links.unionByName(found)
        comp = components(links, scratch)

    for r in range(rounds):
        pairs = now.where("hub IS NOT NULL").select("id", "hub")
        # of the hubs an item meets, the one it shares most keys with: at most one pair for each item
        met = pairs.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("k"))
        best = met.groupBy("id").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub"))
        pairs = scratch.save(best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "tried")
        if not pairs.isEmpty():
            learn(pairs)
            tried = pairs if tried is None else tried.unionByName(pairs)
        if not pairs.isEmpty() or r + 1 < rounds:
            scratch.sweep()
            before, now = now, current(r + 1)
            if before is not p:
                scratch.drop(before)
        if now.isEmpty():  # no key is shared across components any more
            return comp
    most = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
    first = now.join(most, "key").select("key", F.col("id").alias("i"), F.col("v").alias("va"), F.col("comp").alias("ca"), "most")
    second = now.join(most, "key").where("comp <> most").select(F.col("key").alias("k2"), F.col("id").alias("j"), F.col("v").alias("vb"), F.col("comp").alias("cb"))
    pairs = first.join(second, (F.col("key") == F.col("k2")) & (F.col("ca") != F.col("cb")) & ((F.col("ca") == F.col("most")) | (F.col("ca") < F.col("cb"))) & fits(F.col("va"), F.col("vb")))
    need = enough(F.col("va"), F.col("vb")) if enough is not None else F.lit(1)
    pairs = pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), need.alias("need"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    pairs = scratch.save(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "across")
    if not pairs.isEmpty():
        learn(pairs)
    return comp
