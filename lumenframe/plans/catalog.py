"""The engine's queries. `query(name, sql)` registers a function of a table reader; sql is DuckDB's equivalent."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as V
from ..functions import scalar, strings
from ..functions import semantics as S
from ..functions import udf as U
from ..operators import builders as B
from ..operators import relational as R
from ..operators.array import strided
from ..operators.frame import Frame
from ..sources import read, write
from ..sources.read import POS

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}
FLAGSHIP = "w_population"
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = ", ".join(LINE)


def query(name: str, sql: str | None = None):
    def register(f):
        _queries[name] = lambda spark, sf_dir: f(lambda t, *c: read.parquet(spark, sf_dir, t, *c))
        if sql:
            _sql[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


#: Called with the DataFrame of each step of a workload; bench.py materialises them here, for comparison.
STEP: Callable[[DataFrame], DataFrame] = lambda df: df


def r2(c):
    return F.round(c, 2)


# --- sources


@query("s13_rangeiter", "SELECT (3 + 7 * i)::BIGINT AS value FROM range(0, (100 - 3) // 7) t(i)")
def _(t):
    return read.range_iter(t("region").sparkSession, 3, 100, 7).select("value")


@query("s14_vector_literal", "SELECT unnest([1, 2, 3, 5, 8])::BIGINT AS value")
def _(t):
    return t("region").limit(1).select(F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3, 5, 8)])).alias("value"))


@query("s15_random")
def _(t):
    return read.random(t("region").sparkSession, 1000, 7).select((F.col("value") < 1).alias("below_one")).groupBy("below_one").count()


@query("s12_dropna", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_custkey IS NOT NULL")
def _(t):
    return t("customer", "c_custkey", "c_acctbal").na.drop()


@query("s11_concat_files", "SELECT o_orderkey AS k, 'orders' AS src FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def _(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), F.lit("orders").alias("src"))
    return a.unionByName(t("customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("src")))


# --- projections, filters, control flow


@query("p1_map", f"SELECT {LINE_SQL}, l_quantity * 2 + 1 AS v FROM lineitem")
def _(t):
    f = Frame.of(t("lineitem", *LINE, "l_quantity"))
    f["v"] = f["l_quantity"] * 2 + 1
    return f.rows(*LINE, "v")


@query("p2_filter", f"SELECT {LINE_SQL}, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def _(t):
    f = Frame.of(t("lineitem", *LINE, "l_quantity", "l_discount"))
    return f[(f["l_quantity"] > 25) & (f["l_discount"] < 0.05)].rows(*LINE, "l_quantity")


@query("p3_flatten", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.explode("embedding").alias("x"))


@query("p4_flatmap", "SELECT vec_id, unnest(list_filter(list_transform(embedding, lambda x: x * 2), lambda x: x > 0)) AS x FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.explode(V.filter_(V.map_(F.col("embedding"), lambda x: x * F.lit(2).cast("float")), lambda x: x > 0)).alias("x"))


@query("p6_replace_where", f"SELECT {LINE_SQL}, CASE WHEN l_quantity > 40 THEN 40.0 ELSE l_quantity END AS q FROM lineitem")
def _(t):
    f = Frame.of(t("lineitem", *LINE, "l_quantity"))
    f["q"] = f["l_quantity"].replace_where(f["l_quantity"] > 40, 40.0)
    return f.rows(*LINE, "q")


@query("p7_keep_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def _(t):
    f = Frame.of(t("orders", "o_orderkey", "o_totalprice"))
    return f[f["o_totalprice"] > 200000].rows()


@query("p8_positional_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    f = Frame.of(read.with_position(t("orders", "o_orderkey"), "o_orderkey"), read.POS)
    return f["o_orderkey"][100:150].rows()


@query("p9_select_and", "SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_retailprice < 1500")
def _(t):
    f = Frame.of(t("part"), "p_partkey")
    f = f[f["p_size"] > 10]
    return f[f["p_retailprice"] < 1500].rows("p_partkey", "p_brand")


@query("p10_with_column", "SELECT c_custkey, c_acctbal, c_acctbal * 2 AS twice FROM customer")
def _(t):
    f = Frame.of(t("customer", "c_custkey", "c_acctbal"), "c_custkey")
    f["twice"] = f["c_acctbal"] * 2
    return f.rows()


@query("p11_assign_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS bal FROM customer")
def _(t):
    f = Frame.of(t("customer"), "c_custkey")
    f["bal"] = f["c_acctbal"]
    return f.assign_where("bal", f["bal"] < 0, 0.0).rows("c_custkey", "bal")


@query("p12_values", "SELECT p_partkey, [p_size::DOUBLE, p_retailprice] AS row FROM part WHERE p_size > 40")
def _(t):
    f = Frame.of(t("part"), "p_partkey")
    return f.values("p_size", "p_retailprice", where=f["p_size"] > 40).select("p_partkey", "row")


@query("p14_zip_unzip", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return t("customer").select(F.struct("c_custkey", "c_acctbal").alias("s")).select("s.*")


@query("p15_group", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, max(c_custkey) AS top FROM customer")
def _(t):
    total = R.summary(t("customer"), "c_acctbal", ["count", "sum"], True).groupBy().pivot("agg", ["count", "sum"]).agg(F.first("value"))
    top = B.Merger({"top": ("max", "c_custkey", "int64")}).add(t("customer")).result()
    return total.select(F.col("count").cast("bigint").alias("n"), r2(F.col("sum")).alias("total")).withColumn("top", top.scalar())


@query("p16_compare_text", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment >= 'MACHINERY'")
def _(t):
    f = Frame.of(t("customer"), "c_custkey")
    return f[(f["c_mktsegment"] == "BUILDING") | (f["c_mktsegment"] >= "MACHINERY")].rows("c_custkey")


@query("p19_booleans", f"SELECT {LINE_SQL}, (l_quantity > 10 AND NOT l_returnflag = 'A') OR l_tax > 0.05 AS b FROM lineitem")
def _(t):
    f = Frame.of(t("lineitem", *LINE, "l_quantity", "l_returnflag", "l_tax"))
    f["b"] = ((f["l_quantity"] > 10) & ~(f["l_returnflag"] == "A")) | (f["l_tax"] > 0.05)
    return f.rows(*LINE, "b")


@query("p20_if", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k FROM part")
def _(t):
    return t("part").select("p_partkey", scalar.select(F.col("p_size") > 25, F.lit("big"), F.lit("small")).alias("k"))


@query("p24_iterate", "WITH RECURSIVE r(k, x, n) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT k, x // 2, n + 1 FROM r WHERE n = 0 OR x > 10) SELECT k AS c_custkey, min(x)::BIGINT AS x FROM r WHERE n > 0 GROUP BY k")
def _(t):
    step = lambda x: S.int_div(x, F.lit(2))
    return t("customer").select("c_custkey", scalar.iterate(F.col("c_custkey"), step, lambda x: x <= 10, 64).alias("x"))


@query("p25_assert", "SELECT c_custkey FROM customer")
def _(t):
    return t("customer").select(S.require(F.col("c_custkey") >= 0, F.col("c_custkey")).alias("c_custkey"))


@query("p26_struct", "SELECT n_nationkey, n_regionkey AS r FROM nation")
def _(t):
    return t("nation").select("n_nationkey", F.struct(F.col("n_name").alias("_0"), F.col("n_regionkey").alias("_1")).getField("_1").alias("r"))


@query("p28_loc", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def _(t):
    return R.semi(t("orders", "o_orderkey", "o_custkey"), t("customer").where("c_acctbal > 9000"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


# --- joins


@query("j1_natural", "SELECT o_custkey AS custkey, o_orderkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    a = t("orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    return R.merge(a, t("customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_nationkey"))


@query("j1b_natural_strict", "SELECT o_custkey AS custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    a = t("orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return R.merge(a, t("customer").select(F.col("c_custkey").alias("custkey"), "c_name"), strict=True)


@query("j1c_natural_two_keys", "SELECT l_orderkey AS a, l_suppkey AS b, x.n, y.q FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) x JOIN (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2) y USING (l_orderkey, l_suppkey)")
def _(t):
    k = t("lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    return R.merge(k.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), k.where("l_quantity > 30").groupBy("a", "b").agg(F.sum("l_quantity").alias("q")))


@query("j2_hash", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return R.merge(t("supplier").withColumnRenamed("s_nationkey", "nationkey"), t("nation").withColumnRenamed("n_nationkey", "nationkey")).select("s_suppkey", "n_name")


@query("j3_isin", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS hit FROM part")
def _(t):
    return R.isin(t("part", "p_partkey"), "p_partkey", t("lineitem").where("l_quantity > 49"), "l_partkey", "hit")


@query("j4_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return R.anti(t("customer", "c_custkey"), t("orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey")


@query("j5_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey")
def _(t):
    a, b = (t("nation").select(F.col("n_nationkey").alias(n)) for n in "xy")
    return R.theta(a, b, F.col("y") > F.col("x"))


@query("j6_optlookup", "SELECT c_custkey, n IS NOT NULL AS found, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    n = t("orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return R.optlookup(t("customer", "c_custkey"), n, "c_custkey", "n", 0, "o").select("c_custkey", "o.found", F.col("o.value").alias("n"))


@query("j7_zip", "SELECT a.i AS pos, a.embedding[1] AS x, b.embedding[2] AS y FROM (SELECT vec_id AS i, embedding FROM embeddings) a JOIN (SELECT vec_id AS i, embedding FROM embeddings) b USING (i)")
def _(t):
    e = t("embeddings").withColumnRenamed("vec_id", POS)
    return R.zip_join(e.select(POS, F.col("embedding")[0].alias("x")), e.select(POS, F.col("embedding")[1].alias("y"))).withColumnRenamed(POS, "pos")


@query("j8_align", "SELECT c_custkey AS k, c_acctbal + c_acctbal AS bal, 'NaN'::DOUBLE AS only_left, 'NaN'::DOUBLE AS only_right FROM customer")
def _(t):
    from ..operators.frame import Frame

    c = t("customer").withColumn(POS, F.col("c_custkey"))
    a = Frame(dtypes={"bal": "float64", "only_left": "int32"}, _df=c.select(POS, F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("only_left")))
    b = Frame(dtypes={"bal": "float64", "only_right": "int32"}, _df=c.select(POS, F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("only_right")))
    return a.add(b).df.withColumnRenamed(POS, "k")


# --- aggregations


@query("a1_appender", "SELECT list(n_name ORDER BY n_nationkey) AS value FROM nation")
def _(t):
    return B.Appender("n_name").add(t("nation").withColumn(POS, F.col("n_nationkey"))).vector()


@query("a2_merger", "SELECT sum(l_quantity) + 10 AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def _(t):
    aggs = {"s": ("+", "l_quantity", "float64"), "lo": ("min", "l_extendedprice", "float64"), "hi": ("max", "l_extendedprice", "float64")}
    return B.Merger(aggs, {"s": 10.0}).add(t("lineitem")).result()


@query("a2_merger_empty", "SELECT 0::BIGINT AS s, 9223372036854775807 AS lo, (-9223372036854775807 - 1)::BIGINT AS hi")
def _(t):
    aggs = {"s": ("+", "l_orderkey", "int64"), "lo": ("min", "l_orderkey", "int64"), "hi": ("max", "l_orderkey", "int64")}
    return B.Merger(aggs).add(t("lineitem").where("l_quantity < 0")).result()


@query("a3_dictmerger", "SELECT l_partkey, sum(l_quantity) AS s, max(l_tax) AS hi FROM lineitem GROUP BY 1")
def _(t):
    return B.DictMerger(["l_partkey"], {"s": ("+", "l_quantity"), "hi": ("max", "l_tax")}).add(t("lineitem")).result()


@query("a4_groupmerger", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return B.GroupMerger(["o_custkey"], "o_orderkey", ["o_orderkey"]).add(t("orders")).result()


@query("a5_vecmerger", "SELECT p_partkey AS pos, p_size + coalesce(n, 0) AS value FROM (SELECT p_partkey, p_size::BIGINT AS p_size FROM part) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def _(t):
    base = t("part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("value"))
    ones = t("lineitem").select(F.col("l_partkey").alias("pos"), F.lit(1).cast("bigint").alias("value"))
    return B.VecMerger(base, "+", "pos").add(R.semi(ones, t("part"), "pos", "p_partkey")).result()


@query("a6_multi", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"))


@query("a8_tovec", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    d = B.DictMerger(["n_regionkey"], {"n": ("+", "one")}).add(t("nation").withColumn("one", F.lit(1).cast("bigint"))).dictionary()
    return d.select(F.explode(V.tovec(F.col("dict"))).alias("e")).select(F.col("e.key.n_regionkey").alias("k"), F.col("e.value.n").alias("n"))


@query("a10_resumed", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS s, max(c_custkey) AS hi FROM customer GROUP BY 1")
def _(t):
    b, c = B.DictMerger(["c_nationkey"], {"s": ("+", "c_acctbal"), "hi": ("max", "c_custkey")}), t("customer")
    for i in range(3):
        b.add(c.where(F.col("c_custkey") % 3 == i))
    return b.result().withColumn("s", r2(F.col("s")))


@query("a12_count_min_max", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS s FROM orders")
def _(t):
    c = F.col("o_totalprice")
    return t("orders").agg(R.AGGS["count"](c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), r2(F.sum(c)).alias("s"))


@query("a14_agg_list", "SELECT unnest(['count', 'sum', 'mean', 'var', 'std', 'min', 'max']) AS agg, round(unnest([count(*)::DOUBLE, sum(l_quantity), avg(l_quantity), var_samp(l_quantity), stddev_samp(l_quantity), min(l_quantity), max(l_quantity)]), 4) AS value FROM lineitem")
def _(t):
    return R.summary(t("lineitem"), "l_quantity", ["count", "sum", "mean", "var", "std", "min", "max"], True).select("agg", F.round("value", 4).alias("value"))


@query("a17_prod", "SELECT n_regionkey, product(n_nationkey + 1)::BIGINT AS p FROM nation GROUP BY 1")
def _(t):
    return R.GroupBy(t("nation").select("n_regionkey", (F.col("n_nationkey") + 1).alias("p")), "n_regionkey").prod()


@query("a23_unique", "SELECT DISTINCT p_brand, p_size FROM part")
def _(t):
    f = Frame.of(t("part", "p_partkey", "p_brand", "p_size"), "p_partkey")
    return R.GroupBy(f.rows(), ["p_brand", "p_size"], []).size().drop("size")


@query("a23_series_unique", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return Frame.of(t("part", "p_partkey", "p_brand"), "p_partkey")["p_brand"].unique().rows()


@query("a32_series_aggregates", "SELECT (sum(l_partkey * l_partkey) % 18446744073709551616)::BIGINT AS s, count(*) AS n, min(l_suppkey) AS lo FROM lineitem")
def _(t):
    f = Frame.of(t("lineitem", "l_partkey", "l_suppkey"))
    s = f["l_partkey"] * f["l_partkey"]
    one = R.summary(s.rows(), "l_partkey", ["sum", "count"], False, "int64").groupBy().pivot("agg", ["sum", "count"]).agg(F.first("value"))
    lo = R.summary(f.rows(), "l_suppkey", ["min"], False, "int64").select("value")
    return one.select(F.col("sum").alias("s"), F.col("count").alias("n")).withColumn("lo", lo.scalar())


@query("a24_groupby_sum", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def _(t):
    g = R.GroupBy(t("lineitem"), ["l_returnflag", "l_linestatus"])[["l_quantity", "l_extendedprice"]]
    return g.sum().withColumn("l_extendedprice", r2(F.col("l_extendedprice")))


@query("a25_size", "SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1")
def _(t):
    return R.GroupBy(t("orders"), "o_custkey").size()


@query("a26_groupby_std", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY 1")
def _(t):
    return R.GroupBy(t("lineitem"), "l_returnflag")["l_quantity"].std().withColumn("l_quantity", F.round("l_quantity", 6))


@query("a27_mean_count", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, count(*) AS n FROM part GROUP BY 1")
def _(t):
    g = R.GroupBy(t("part"), "p_brand")["p_retailprice"]
    return R.merge(g.mean().select("p_brand", F.round("p_retailprice", 4).alias("mean")), g.count().select("p_brand", F.col("p_retailprice").alias("n")))


@query("a28_apply", "SELECT c_mktsegment, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1")
def _(t):
    return R.GroupBy(t("customer"), "c_mktsegment", "c_acctbal").apply(lambda g: g.max())


def _pivot(t, how):
    p = R.pivot_table(t("lineitem"), "l_quantity", "l_suppkey", "l_returnflag", ["A", "N", "R"], how)
    return p


for _how, _f in (("sum", "sum"), ("mean", "avg")):
    query(f"a29_pivot_{_how}", "SELECT l_suppkey, " + ", ".join(f"round({_f}(l_quantity) FILTER (l_returnflag = '{x}'), 6) AS {x}" for x in "ANR") + " FROM lineitem GROUP BY 1")(lambda t, h=_how: _pivot(t, h).df.select("l_suppkey", *[F.round(x, 6).alias(x) for x in "ANR"]))


@query("a30_pivot_div", "SELECT l_suppkey, " + ", ".join(f"round(sum(l_quantity) FILTER (l_returnflag = '{x}') / sum(l_quantity), 6) AS {x}" for x in "ANR") + " FROM lineitem GROUP BY 1")
def _(t):
    p = _pivot(t, "sum")
    return p.div(p.total()).df.select("l_suppkey", *[F.round(x, 6).alias(x) for x in "ANR"])


@query("a31_reset_index", "SELECT o_custkey, unnest(l) AS o_orderkey FROM (SELECT o_custkey, list(o_orderkey) AS l FROM orders GROUP BY 1)")
def _(t):
    g = B.GroupMerger(["o_custkey"], "o_orderkey", ["o_orderkey"]).add(t("orders")).result()
    return g.select("o_custkey", F.explode("o_orderkey").alias("o_orderkey"))


@query("a34_share", "SELECT c_custkey, round(c_acctbal / (SELECT sum(c_acctbal) FROM customer), 9) AS share FROM customer")
def _(t):
    return R.fill_by_total(t("customer", "c_custkey", "c_acctbal"), "c_acctbal", "share").select("c_custkey", F.round("share", 9).alias("share"))


# --- windows, sorts, slices


def _topn(asc):
    return lambda t: R.GroupBy(t("orders", "o_custkey", "o_orderkey", "o_totalprice"), "o_custkey").sort_values("o_totalprice", asc, ["o_orderkey"]).slice(0, 2).reset_index()


for _asc, _n in ((False, "w1_topn"), (True, "w1_bottomn")):
    query(_n, f"SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice {'ASC' if _asc else 'DESC'}, o_orderkey) <= 2")(_topn(_asc))


@query("w2_index", "SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation")
def _(t):
    return read.with_position(t("nation"), "n_nationkey").select("n_name", F.col(POS).alias("i"))


@query("o1_series_sort", "SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos, p_retailprice FROM part")
def _(t):
    f = Frame.of(t("part", "p_partkey", "p_retailprice"), "p_partkey")
    s = f["p_retailprice"].sort_values()
    return s.df.select(F.col(POS).alias("pos"), "p_retailprice")


@query("o2_compare", "SELECT c_custkey, CASE WHEN c_acctbal < 5000 THEN -1 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS c FROM customer")
def _(t):
    return t("customer").select("c_custkey", scalar.compare(F.col("c_acctbal"), F.lit(5000.0)).alias("c"))


@query("o2_sort_with", "SELECT vec_id, list_sort(embedding[1:6], 'DESC') AS v FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.sort_with(V.slice_(F.col("embedding"), 0, 6), lambda x, y: scalar.compare(y, x)).alias("v"))


@query("p13_get_column", "SELECT vec_id, embedding[1:3] AS v, embedding[2] AS x FROM embeddings")
def _(t):
    z = V.zip_(V.slice_(F.col("embedding"), 0, 3), V.slice_(F.col("embedding"), 0, 3))
    return t("embeddings").select("vec_id", V.get_column(z, 1).alias("v"), V.get_field(V.lookup(z, 1), 0).alias("x"))


@query("p28_series_loc", "SELECT p_partkey AS key, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    part = t("part", "p_partkey", "p_size")
    s = Frame.of(part.withColumn("__index", F.col("p_partkey")), "p_partkey")
    s = s["p_size"]
    keys = Frame.of(t("lineitem", "l_partkey", "l_quantity"))
    found = s.loc[keys[keys["l_quantity"] > 49]["l_partkey"]]
    return found._df.select(F.col(POS).alias("key"), "p_size")


@query("f17_frame_compare", "SELECT c_custkey AS k, c_acctbal > 100 AS c_acctbal, c_nationkey::BIGINT > 100 AS c_nationkey FROM customer")
def _(t):
    f = Frame.of(t("customer", "c_custkey", "c_acctbal", "c_nationkey"), "c_custkey")[["c_acctbal", "c_nationkey"]]
    return (f > 100)._df.withColumnRenamed(POS, "k")


@query("f17_frame_mod", "SELECT p_partkey AS k, p_size % 7 AS p_size, p_partkey % 7 AS p_partkey FROM part")
def _(t):
    f = Frame.of(t("part", "p_partkey", "p_size"), "p_partkey")
    return (f % 7)._df.withColumnRenamed(POS, "k")


@query("o1_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def _(t):
    return t("orders", "o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey")


@query("o1_sort_vector", "SELECT vec_id, list_sort(embedding, 'DESC') AS v FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.sort(F.col("embedding"), descending=True).alias("v"))


@query("o3_struct_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey)::INTEGER AS rn FROM orders QUALIFY rn <= 100")
def _(t):
    s = F.struct("o_orderpriority", "o_totalprice", "o_orderkey")
    top = t("orders").select(s.alias("s")).orderBy("s").limit(100)
    return read.with_position(top, "s").select(F.col("s.o_orderkey").alias("o_orderkey"), (F.col(POS) + 1).cast("int").alias("rn"))


_O3 = "(SELECT *, {'p': o_orderpriority, 't': o_totalprice, 'k': o_orderkey} AS s FROM orders)"


@query("o3_struct_compare", "SELECT o_orderkey, s < {'p': '3-MEDIUM', 't': 100000.0::DOUBLE, 'k': 0::BIGINT} AS below FROM " + _O3)
def _(t):
    s, other = F.struct("o_orderpriority", "o_totalprice", "o_orderkey"), F.struct(F.lit("3-MEDIUM"), F.lit(100000.0), F.lit(0).cast("bigint"))
    return t("orders").select("o_orderkey", (s < other).alias("below"))


@query("o3_struct_extremes", "SELECT o_custkey, min(s).k AS lo, max(s).k AS hi FROM " + _O3 + " GROUP BY 1")
def _(t):
    s = F.struct("o_orderpriority", "o_totalprice", "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.min(s)["o_orderkey"].alias("lo"), F.max(s)["o_orderkey"].alias("hi"))


@query("o6_slice", "SELECT vec_id, embedding[3:7] AS v FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.slice_(F.col("embedding"), 2, 5).alias("v"))


@query("o8_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return R.top_k(t("orders", "o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("o9_stride", "SELECT p_partkey FROM part WHERE p_partkey >= 10 AND p_partkey < 10 + (500 - 10) // 7 * 7 AND (p_partkey - 10) % 7 = 0")
def _(t):
    return R.strided_rows(t("part", "p_partkey"), 10, 500, 7, "p_partkey")


@query("o9_stride_vector", "SELECT vec_id, [embedding[1], embedding[4], embedding[7]] AS v FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.strided(F.col("embedding"), 0, 10, 3).alias("v"))


@query("s_union", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionAll(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("s_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(t):
    return t("orders").select(F.col("o_custkey").alias("k")).intersect(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("s_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")))


# --- scalars


@query("f1_arith", f"SELECT {LINE_SQL}, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS s, l_partkey * 3 AS m, (l_partkey - 1000) // 7 AS d0, CASE WHEN l_partkey < 1000 THEN -((1000 - l_partkey) // 7) ELSE (l_partkey - 1000) // 7 END AS d, (l_partkey - 1000) % 7 AS r FROM lineitem".replace("(l_partkey - 1000) // 7 AS d0, ", ""))
def _(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return t("lineitem").select(*LINE, (p + s).alias("a"), (p - s).alias("s"), (p * 3).alias("m"), S.int_div(p - 1000, F.lit(7)).alias("d"), S.remainder(p - 1000, F.lit(7)).alias("r"))


@query("f2_compare", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def _(t):
    names = dict(zip(("eq", "ne", "lt", "le", "gt", "ge"), ("==", "!=", "<", "<=", ">", ">="), strict=True))
    return t("part").select("p_partkey", *[S.COMPARE[op](F.col("p_size"), F.lit(10)).alias(n) for n, op in names.items()])


@query("f3_bitwise", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 255 AS o, xor(o_orderkey, 255) AS x FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", *[scalar.bit(op, k, F.lit(255).cast("bigint")).alias(n) for op, n in (("&", "a"), ("|", "o"), ("^", "x"))])


@query("f4_minmax", f"SELECT {LINE_SQL}, least(l_quantity, l_tax * 500) AS lo, greatest(l_quantity, l_tax * 500) AS hi FROM lineitem")
def _(t):
    a, b = F.col("l_quantity"), F.col("l_tax") * 500
    return t("lineitem").select(*LINE, scalar.least(a, b).alias("lo"), scalar.greatest(a, b).alias("hi"))


@query("f5_pow", "SELECT p_partkey, round(pow(p_retailprice / 1000, 1.5), 6) AS v FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(scalar.power(F.col("p_retailprice") / 1000, F.lit(1.5)), 6).alias("v"))


@query("f7_unary", "SELECT p_partkey, round(exp(p_size / 50.0), 8) AS e, round(ln(p_retailprice), 8) AS l, round(sqrt(p_retailprice), 8) AS s, -p_size AS n FROM part")
def _(t):
    x = F.col("p_retailprice")
    return t("part").select("p_partkey", F.round(F.exp(F.col("p_size") / 50.0), 8).alias("e"), F.round(S.ieee_log(x), 8).alias("l"), F.round(S.ieee_sqrt(x), 8).alias("s"), (-F.col("p_size")).alias("n"))


@query("f8_trig", "SELECT l_linenumber, l_tax, " + ", ".join(f"round({f}(l_tax), 8) AS {f}_x" for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh")) + " FROM (SELECT DISTINCT l_linenumber, l_tax FROM lineitem)")
def _(t):
    d = t("lineitem", "l_linenumber", "l_tax").distinct()
    return d.select("*", *[F.round(scalar.UNARY[f](F.col("l_tax")), 8).alias(f"{f}_x") for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh")])


@query("f9_erf")
def _(t):
    return t("part").select("p_partkey", scalar.erf(F.col("p_retailprice") / 1000).alias("v"))


@query("f10_cast", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, ((o_orderkey + 128) % 256 - 128)::TINYINT AS b, o_totalprice::FLOAT AS f, o_orderkey <> 0 AS t FROM orders")
def _(t):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return t("orders").select("o_orderkey", S.wrap_cast(p, "int64", "float64").alias("i"), S.wrap_cast(k, "int8", "int64").alias("b"), S.wrap_cast(p, "float32", "float64").alias("f"), S.wrap_cast(k, "bool", "int64").alias("t"))


@query("f11_literals", "SELECT 255 AS h, 5 AS b, 1.5::DOUBLE AS d, true AS t")
def _(t):
    return t("region").limit(1).select(scalar.integer("0xff").alias("h"), scalar.integer("0b101").alias("b"), F.lit(1.5).alias("d"), F.lit(True).alias("t"))


@query("f12_lookup", "SELECT vec_id, embedding[6] AS x FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.lookup(F.col("embedding"), 5).alias("x"))


@query("f13_dict", "SELECT label, true AS has, count(*) AS n, true AS found, false AS missing FROM embeddings GROUP BY label")
def _(t):
    d = t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    m = d.select("label", F.create_map("label", "n").alias("m"))
    return m.select("label", V.keyexists(F.col("m"), F.col("label")).alias("has"), V.dict_lookup(F.col("m"), F.col("label")).alias("n"), V.optlookup(F.col("m"), F.col("label"), F.lit(0).cast("bigint"))["found"].alias("found"), V.optlookup(F.col("m"), F.col("label") + 1000, F.lit(0).cast("bigint"))["found"].alias("missing"))


@query("f14_len", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.length(F.col("embedding")).alias("n"))


_W = [((i * 37) % 11 - 5) / 8 for i in range(64)]


@query("f23_dot", "SELECT vec_id, round(" + " + ".join(f"embedding[{i + 1}]::DOUBLE * {w}::DOUBLE" for i, w in enumerate(_W)) + ", 6) AS v FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), _W), 6).alias("v"))


@query("f23_dot_columns", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS v FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.round(V.dot_columns(F.col("embedding"), F.col("embedding")), 6).alias("v"))


@query("a5_scatter_vector", "SELECT vec_id, [embedding[1] + 1, embedding[2], embedding[3] + 2::FLOAT + 3::FLOAT]::FLOAT[] AS v FROM embeddings")
def _(t):
    u = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).cast("float").alias("v")) for i, v in ((0, 1.0), (2, 2.0), (2, 3.0))])
    return t("embeddings").select("vec_id", V.scatter(V.slice_(F.col("embedding"), 0, 3), u, "+").alias("v"))


@query("j7_zip_vector", "SELECT vec_id, list_transform(embedding, lambda x: x * 2)[1:4] AS v FROM embeddings")
def _(t):
    z = V.zip_(F.col("embedding"), F.col("embedding"))
    return t("embeddings").select("vec_id", V.slice_(V.map_(z, lambda s: s["_0"] + s["_1"]), 0, 4).alias("v"))


# --- strings

for _name, _fn, _s in (
    ("t1_lower", strings.lower, "lower(p_name)"),
    ("t2_upper", strings.upper, "upper(p_name)"),
    ("t3_capitalize", strings.capitalize, "upper(p_name[1]) || lower(p_name[2:])"),
    ("t4_get", lambda c: F.concat_ws("|", strings.get(c, 0), strings.get(c, 3), strings.get(c, -2), strings.get(c, 99)), "concat_ws('|', substr(p_name, 1, 1), substr(p_name, 4, 1), substr(p_name, length(p_name) - 1, 1), '')"),
    ("t5_strip", lambda c: strings.strip(F.concat(F.lit(" \t\n"), c, F.lit("\r\x0b "))), "p_name"),
    ("t6_contains", lambda c: strings.contains(c, "ar"), "contains(p_name, 'ar')"),
    ("t7_startswith", lambda c: strings.startswith(c, "p"), "starts_with(p_name, 'p')"),
    ("t8_endswith", lambda c: strings.endswith(c, "1"), "ends_with(p_name, '1')"),
    ("t9_find", lambda c: strings.find(c, "a"), "strpos(p_name, 'a')::BIGINT - 1"),
    ("t10_replace", lambda c: strings.replace(c, "a", "<A>"), "CASE WHEN strpos(p_name, 'a') > 0 THEN p_name[:strpos(p_name, 'a') - 1] || '<A>' || p_name[strpos(p_name, 'a') + 1:] ELSE p_name END"),
    ("t11_slice", lambda c: strings.slice_(c, 2, 4), "substr(p_name, 3, 4)"),
):
    query(_name, f"SELECT p_partkey, {_s} AS v FROM part")(lambda t, f=_fn: t("part").select("p_partkey", f(F.col("p_name")).alias("v")))


@query("t14_equal", "SELECT a.p_partkey FROM part a WHERE a.p_brand = 'Brand#11' OR a.p_type <> a.p_brand")
def _(t):
    f = Frame.of(t("part"), "p_partkey")
    return f[(f["p_brand"] == "Brand#11") | (f["p_type"] != f["p_brand"])].rows("p_partkey")


# --- UDFs and bytes


@query("k5_serde", "SELECT vec_id, embedding, label FROM embeddings")
def _(t):
    kind = T.ArrayType(T.FloatType())
    return t("embeddings").withColumn("b", write.serialize(F.col("embedding"), kind)).select("vec_id", write.deserialize(F.col("b"), kind).alias("embedding"), "label")


@query("u1_udf", "SELECT p_partkey, p_retailprice * 2 + 1 AS v FROM part")
def _(t):
    part = t("part")
    U.register(part.sparkSession, "twice_and_one", lambda x: x * 2 + 1, "double")
    return part.select("p_partkey", U.call("twice_and_one", "p_retailprice").alias("v"))


@query("u1_expanding", "SELECT p_partkey, unnest(range(p_size % 4)) AS i FROM part")
def _(t):
    part = t("part", "p_partkey", "p_size")
    U.expanding(part.sparkSession, "counted", lambda n: ((i,) for i in range(n % 4)), "i long")
    part.createOrReplaceTempView("u1_expanding_part")
    return part.sparkSession.sql("SELECT p_partkey, i FROM u1_expanding_part, LATERAL counted(p_size)")


@query("a28_apply_in_pandas", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def _(t):
    spread = lambda g: pd.DataFrame({"c_mktsegment": g["c_mktsegment"][:1], "spread": [g["c_acctbal"].max() - g["c_acctbal"].min()]})
    return R.GroupBy(t("customer", "c_mktsegment", "c_acctbal"), "c_mktsegment").apply_in_pandas(spread, "c_mktsegment string, spread double")


@query("u1_vector_udf", "SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def _(t):
    counts = lambda b: b.group_by("p_size").aggregate([([], "count_all")]).rename_columns(["p_size", "n"])
    return U.over_batches(t("part", "p_size"), counts, "p_size int, n long").groupBy("p_size").agg(F.sum("n").alias("n"))


# --- streams: the batch form of each lifted reduction


@query("st_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming import aggregates

    e = t("events").withColumn("one", F.lit(1).cast("bigint"))
    out = aggregates.windowed(e, "ts", "1 hour", "1 day", ["event_type"], {"n": ("+", "one"), "s": ("+", "value")})
    return out.withColumn("s", F.round("s", 4))


@query("st_keyed", "SELECT event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY 1")
def _(t):
    from ..streaming import aggregates

    return aggregates.keyed(t("events").withColumn("one", F.lit(1).cast("bigint")), ["event_type"], {"n": ("+", "one"), "hi": ("max", "value")})


# --- workloads


@query("w_population", "WITH f AS (SELECT l_returnflag AS state, exp((l_extendedprice * 0.1 + l_quantity * 2.0 - l_tax * 10.0) / 10000) AS e FROM lineitem WHERE l_quantity > 10) SELECT state, round(sum(e / (SELECT sum(e) FROM f)), 8) AS share FROM f GROUP BY 1")
def _(t):
    rows = STEP(t("lineitem", "l_returnflag", "l_extendedprice", "l_quantity", "l_tax").where("l_quantity > 10"))
    v = F.array("l_extendedprice", "l_quantity", "l_tax")
    e = STEP(rows.select(F.col("l_returnflag").alias("state"), F.exp(V.dot(v, [0.1, 2.0, -10.0]) / 10000).alias("e")))
    # shares of a total of group sums: one pass over the rows
    return R.fill_by_total(STEP(R.GroupBy(e, "state")["e"].sum()), "e", "share").select("state", F.round("share", 8).alias("share"))


@query("w_cleaning", "SELECT DISTINCT CASE WHEN substr(c_name, 10, 5) = '00000' THEN 'nan' ELSE substr(c_name, 10, 5) END AS zip FROM customer")
def _(t):
    zip_ = strings.slice_(F.col("c_name"), 9, 5)
    return t("customer").select(F.when(zip_ == "00000", "nan").otherwise(zip_).alias("zip")).distinct()


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _movielens(t):
    """Ratings with their title, and mean ratings of active titles by title and group with the difference of two."""
    users = t("customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("movie"))
    ratings = t("orders").select(F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("rating"))
    movies = t("nation").select(F.col("n_nationkey").alias("movie"), F.col("n_name").alias("title"))
    data = STEP(R.merge(STEP(R.merge(ratings, users)), movies))
    # sizes, deviations and the pivot are aggregates of one pass: means and counts by title and group, then by title
    group = STEP(data.groupBy("title", "g").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n")))
    cells = [F.max(F.when(F.col("g") == s, F.col("mean"))).alias(s) for s in _SEG]
    p = group.groupBy("title").agg(F.sum("n").alias("n"), *cells).where("n >= 30").drop("n")
    return data, R.Pivot(p, "title", _SEG).with_column("diff", F.col("AUTOMOBILE") - F.col("BUILDING"))


@query("w_movielens", "WITH j AS (SELECT n_name AS title, c_mktsegment AS g, o_totalprice AS rating FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), a AS (SELECT title FROM j GROUP BY 1 HAVING count(*) >= 30), p AS (SELECT title, " + ", ".join(f"avg(rating) FILTER (g = '{s}') AS {s}" for s in _SEG) + " FROM j GROUP BY 1) SELECT title, " + ", ".join(f"round({s}, 4) AS {s}" for s in _SEG) + ", round(AUTOMOBILE - BUILDING, 4) AS diff FROM p WHERE title IN (SELECT title FROM a) ORDER BY AUTOMOBILE - BUILDING, title LIMIT 10")
def _(t):
    out = R.top_k(_movielens(t)[1].df, 10, F.asc_nulls_last("diff"), F.asc("title"))
    return out.select("title", *[F.round(c, 4).alias(c) for c in [*_SEG, "diff"]])


@query("w_movielens_diff", "WITH j AS (SELECT n_name AS title, c_mktsegment AS g, o_totalprice AS rating FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), a AS (SELECT title FROM j GROUP BY 1 HAVING count(*) >= 30), p AS (SELECT title, " + ", ".join(f"avg(rating) FILTER (g = '{s}') AS {s}" for s in _SEG) + " FROM j GROUP BY 1) SELECT title, " + ", ".join(f"round({s}, 4) AS {s}" for s in _SEG) + ", round(AUTOMOBILE - BUILDING, 4) AS diff FROM p WHERE title IN (SELECT title FROM a) ORDER BY AUTOMOBILE - BUILDING, title")
def _(t):
    out = _movielens(t)[1].df.orderBy(F.asc_nulls_last("diff"), "title")
    return out.select("title", *[F.round(c, 4).alias(c) for c in [*_SEG, "diff"]])


@query("w_movielens_deviation", "SELECT n_name AS title, round(stddev_samp(o_totalprice), 2) AS deviation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 30 ORDER BY stddev_samp(o_totalprice) DESC, title LIMIT 10")
def _(t):
    data, _ = _movielens(t)
    std = data.groupBy("title").agg(F.stddev_samp("rating").alias("deviation"), F.count(F.lit(1)).alias("n")).where("n >= 30")
    return R.top_k(std, 10, F.desc("deviation"), F.asc("title")).select("title", F.round("deviation", 2).alias("deviation"))


@query("w_births", "WITH b AS (SELECT year(l_shipdate)::INTEGER AS y, l_returnflag AS sex, p_name AS name, sum(l_quantity) AS births FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), top AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY y, sex ORDER BY births DESC, name) <= 100), p AS (SELECT y, " + ", ".join(f"sum(births) FILTER (sex = '{x}') AS {x}" for x in "ANR") + " FROM top WHERE contains(lower(name), 'a') GROUP BY 1) SELECT y, " + ", ".join(f"round({x} / (coalesce(A, 0) + coalesce(N, 0) + coalesce(R, 0)), 6) AS {x}" for x in "ANR") + " FROM p")
def _(t):
    names = t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    rows = t("lineitem").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("sex"), F.col("l_quantity").alias("births"))
    births = STEP(R.GroupBy(STEP(R.merge(rows, names).drop("k")), ["y", "sex", "name"])["births"].sum())
    top = STEP(R.GroupBy(births, ["y", "sex"]).sort_values("births", False, ["name"]).slice(0, 100).reset_index())
    p = R.pivot_table(top.where(strings.contains(strings.lower(F.col("name")), "a")), "births", "y", "sex", ["A", "N", "R"])
    return p.div(p.total()).df.select("y", *[F.round(x, 6).alias(x) for x in "ANR"])


@query("i5_ndstride", "SELECT a * 12 + b * 4 + c AS pos, p_size AS value FROM range(4) x(a), range(3) y(b), range(4) z(c) JOIN part ON p_partkey = 1 + a * 36 + b * 12 + c * 3")
def _(t):
    # a walk over three dimensions of a vector that lies flat
    data = t("part").select(F.col("p_partkey").alias(POS), F.col("p_size").alias("value"))
    return strided(data, 1, (4, 3, 4), (36, 12, 3)).withColumnRenamed(POS, "pos")
