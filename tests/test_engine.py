"""Differential tests against NumPy and pandas, and of semantics the tables don't show."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import arrays as V
from lumenframe.functions import scalar, strings
from lumenframe.functions import semantics as S
from lumenframe.operators import builders as B
from lumenframe.operators import relational as R
from lumenframe.operators.frame import Frame, Series, evaluate_together
from lumenframe.sources import read, write

INTS = ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32"]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("left", ["int8", "int32", "int64", "uint8", "float32", "float64"])
@pytest.mark.parametrize("right", ["int16", "uint32", "float32", "float64"])
def test_types(spark, left, right):
    a, b = np.array([1, 2, 3], left), np.array([3, 2, 5], right)
    df = read.from_columns(spark, {"a": a, "b": b})
    x, y = Series(None, left, "a", df, F.col("a")), Series(None, right, "b", df, F.col("b"))
    total = x + y
    assert total.dtype == (a + b).dtype.name
    np.testing.assert_allclose(total.evaluate().astype(float), (a + b).astype(float))
    ratio = x / y
    assert ratio.dtype == ("float32" if {left, right} == {"float32"} else "float64")
    np.testing.assert_allclose(ratio.evaluate().astype(float), a.astype(float) / b.astype(float), rtol=1e-6)


@pytest.mark.parametrize("name", ["int8", "int32", "int64", "uint8"])
def test_wrapping(spark, name):
    info = np.iinfo(name)
    a, b = np.array([info.max, info.min, 7], name), np.array([info.max, 3, 5], name)
    df = read.from_columns(spark, {"a": a, "b": b}, {"a": name, "b": name})
    x, y = Series(None, name, "a", df, F.col("a")), Series(None, name, "b", df, F.col("b"))
    with np.errstate(over="ignore"):
        for got, want in ((x + y, a + b), (x - y, a - b), (x * y, a * b)):
            assert [int(v) for v in got.evaluate()] == [int(v) for v in want]


def test_ieee(spark):
    a, b = [1.0, math.nan, 3.0, 4.0, 6.0], [1.0, math.nan, 2.0, 5.0, math.nan]
    df = read.from_columns(spark, {"a": a, "b": b})
    x, y = Series(None, "float64", "a", df, F.col("a")), Series(None, "float64", "b", df, F.col("b"))
    assert (x == y).evaluate().tolist() == [True, False, False, False, False]
    assert (x != y).evaluate().tolist() == [False, False, True, True, False]
    assert (x < y).evaluate().tolist() == [False, False, False, True, False]
    r = one(spark, S.float_div(F.lit(1.0), F.lit(0.0)).alias("i"), S.float_div(F.lit(0.0), F.lit(0.0)).alias("n"), S.ieee_log(F.lit(0.0)).alias("l"), S.ieee_log(F.lit(-1.0)).alias("m"), S.ieee_sqrt(F.lit(-1.0)).alias("s"), S.int_div(F.lit(-7), F.lit(2)).alias("d"), S.remainder(F.lit(-7), F.lit(3)).alias("r"), S.wrap_cast(F.lit(300), "int8", "int32").alias("c"), S.wrap_cast(F.lit(-2.7), "int32", "float64").alias("f"))
    assert r.i == math.inf and math.isnan(r.n) and r.l == -math.inf and math.isnan(r.m) and math.isnan(r.s)
    assert (r.d, r.r, r.c, r.f) == (-3, -1, 44, -2)


def test_agg_list(spark):
    x = pd.Series(range(-10, 25))
    s = Series(x.to_numpy())
    names = ["count", "sum", "min", "max", "mean", "var", "std"]
    np.testing.assert_allclose(s.agg(names), x.agg(names).to_numpy())
    assert s.agg("sum") == x.sum() and s.mean() == x.mean() and s.agg(["min", "max"]).dtype == np.int64
    assert math.isnan(Series([5]).agg("std"))


def test_series_surface(spark):
    df = read.from_columns(spark, {"x": [5, 1, 4, 1], "y": [1, 2, 3, 4]})
    x, y = Series(None, "int64", "x", df, F.col("x")), Series(None, "int64", "y", df, F.col("y"))
    assert x[x > 2].evaluate().tolist() == [5, 4]
    assert x.replace_where(x == 1, 9).evaluate().tolist() == [5, 9, 4, 9]
    assert x[1:3].evaluate().tolist() == [1, 4] and x[2] == 4
    assert x.isin(Series([4, 5])).evaluate().tolist() == [True, False, True, False]
    assert sorted(x.unique().evaluate()) == [1, 4, 5]
    assert x.sort_values().evaluate().tolist() == [5, 4, 1, 1]
    assert (10 - x).evaluate().tolist() == [5, 9, 6, 9] and (x + Series([1, 1, 1, 1])).evaluate().tolist() == [6, 2, 5, 2]
    a, b = evaluate_together(x + y, x * y)
    assert a.tolist() == [6, 3, 7, 5] and b.tolist() == [5, 2, 12, 4]
    np.testing.assert_allclose(Series([0.0, 0.5]).erf().evaluate(), [0, math.erf(0.5)])
    with pytest.raises(TypeError):
        Series([1, "a", None])
    with pytest.raises(IndexError):
        x[99]


def test_frames_align(spark):
    a = Frame({"name": ["a", "b"], "age": [1, 2], "score": [0.5, 1.5]})
    b = Frame({"first": ["c", "d"], "age": [10, 20], "scores": [1.0, 2.0]})
    r = a.eq(b).evaluate()
    assert list(r.columns) == ["age", "first", "name", "score", "scores"] and r["age"].tolist() == [False, False] and not r["name"].any()
    s = Frame({"age": [1, 2]}).add(Frame({"age": [3, 4]})).evaluate()
    assert s["age"].tolist() == [4, 6]
    f = Frame({"a": [3, 2, 3], "b": [2, 3, 2], "c": [6, 5, 4]})
    f["d"] = f["a"] + f["b"]
    assert f.evaluate()["d"].tolist() == [5, 5, 5]
    got = f.groupby(["a", "b"]).sum().orderBy("a").toPandas()
    assert got[["a", "b", "c"]].values.tolist() == [[2, 3, 5], [3, 2, 10]]


def test_strings(spark):
    texts = ["aaaa", "bbB", "", "  tab\t\n", "Xyx xyx", "ñandú"]
    s = Series(texts)
    for i in (-3, 0, 2):
        assert s.str.get(i).evaluate().tolist() == [t[i] if -len(t) <= i < len(t) else "" for t in texts]
    for args in (("x",), ("x", 1), ("x", 0, 3), ("yx", 2, 7), ("zz",)):
        assert s.str.find(*args).evaluate().tolist() == [t.find(*args) for t in texts]
    assert s.str.find("a", -1).evaluate().tolist() == [-1] * 6
    assert s.str.replace("x", "++").evaluate().tolist() == [t.replace("x", "++", 1) for t in texts]
    assert s.str.strip().evaluate().tolist() == [t.strip() for t in texts]
    assert s.str.capitalize().evaluate().tolist()[1] == "Bbb" and s.str.upper().evaluate().tolist()[5] == "ñANDú".upper().replace("Ñ", "ñ").replace("Ú", "ú")
    assert s.str.contains("y").evaluate().tolist() == ["y" in t for t in texts]
    assert one(spark, strings.lower(F.lit("ABÑ")).alias("v")).v == "abÑ"


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "k int, w int")
    assert sorted(map(tuple, R.merge(a, b).collect())) == [(1, "x", 10), (1, "x", 11), (2, "y", 20)]
    with pytest.raises(Exception, match="unmatched key"):
        R.merge(a, b, strict=True).collect()
    with pytest.raises(ValueError):
        R.merge(a.select("v"), b)
    with pytest.raises(TypeError):
        R.isin(a, "v", b, "w", "o")
    got = R.optlookup(a, b.where("w = 20"), "k", "w", 0, "o").orderBy("k").select("o.*").collect()
    assert list(map(tuple, got)) == [(False, 0), (True, 20), (False, 0)]


def test_topn_and_pivot(spark):
    rows = [(i % 3, i, (i * 7) % 5) for i in range(12)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    want = pd.DataFrame(rows, columns=["a", "b", "c"]).sort_values("b", ascending=False).groupby("a").head(2)
    got = R.GroupBy(df, "a").sort_values("b", ascending=False).slice(0, 2).reset_index().toPandas()
    assert sorted(map(tuple, got[["a", "b", "c"]].values)) == sorted(map(tuple, want[["a", "b", "c"]].values))
    p = R.pivot_table(df.where("a <> 0 or c <> 0"), "b", "a", "c", [0, 1, 2, 3, 4])
    assert p.df.where("a = 0").first()["0"] is None
    shares = p.div(p.total()).df.orderBy("a").toPandas().set_index("a").fillna(0).sum(axis=1)
    np.testing.assert_allclose(shares, 1)


def test_builders(spark):
    base = read.from_columns(spark, {"value": [3, 3, 3, 3, 3]})
    up = spark.createDataFrame([(0, 2), (0, 4), (3, 1)], f"{read.POS} long, value long")
    for op, want in (("+", [9, 3, 3, 4, 3]), ("*", [24, 3, 3, 3, 3]), ("min", [2, 3, 3, 1, 3]), ("max", [4, 3, 3, 3, 3])):
        assert write.to_numpy(B.VecMerger(base, op).add(up).result(), "value").tolist() == want
    kv = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (1, 2), (3, 1)], "k int, v int")
    m = B.DictMerger(["k"], {"s": ("+", "v")})
    assert sorted(map(tuple, m.add(kv).add(kv).result().collect())) == [(1, 8), (2, 14), (3, 2)]
    g = B.GroupMerger(["k"], "v", ["v"]).add(kv).result()
    assert {r.k: list(r.v) for r in g.collect()} == {1: [2, 2], 2: [3, 4], 3: [1]}
    state = B.iterate_rows(spark.createDataFrame([(40,)], "x int"), lambda d: d.select((F.col("x") / 2).cast("int").alias("x")), lambda d: d.first().x < 5, lambda d: spark.createDataFrame(d.collect(), d.schema))
    assert state.first().x == 2
    with pytest.raises(Exception, match="no end"):
        one(spark, scalar.iterate(F.lit(1), lambda x: x, lambda x: F.lit(False), 5).alias("v"))


def test_arrays(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    r = one(spark, V.strided(a, 0, 4, 2).alias("s"), V.slice_(a, 2, 9).alias("c"), V.reduce_(a, "*", F.lit(1)).alias("p"), V.range_(0, 10, 3).alias("r"), V.sort(a, lambda x: x % 2).alias("o"))
    assert (r.s, r.c, r.p, r.r, r.o) == ([1, 3], [3, 4], 24, [0, 3, 6], [2, 4, 1, 3])
    with pytest.raises(Exception, match="different lengths"):
        one(spark, V.zip_(a, F.array(F.lit(1))).alias("z"))
    with pytest.raises(Exception, match="key not found"):
        one(spark, V.dict_lookup(F.create_map(F.lit(1), F.lit(2)), F.lit(3)).alias("v"))


def test_bytes_round_trip(spark):
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.IntegerType(), T.StringType()))])
    value = {"a": 7, "b": [1, -2], "m": {2: "x", 1: "yy"}}
    b = write.pack(value, kind)
    assert len(b) == 4 + 8 + 16 + 8 + (4 + 8 + 2) + (4 + 8 + 1) and write.unpack(b, kind) == value
    with pytest.raises(ValueError):
        write.unpack(b + b"x", kind)


def test_csv(spark, tmp_path):
    p = tmp_path / "a_1999.csv"
    p.write_text("z|n\n10001|1\nNO CLUE|2\nN/A|3\n")
    df = read.csv(spark, str(p), "z string, n int", "|", na_values=["N/A", "NO CLUE"])
    assert [r.z for r in df.orderBy("n").collect()] == ["10001", None, None]
    assert read.csv(spark, str(p), "z string, n int", "|", na_values=["N/A"], drop_na=True).count() == 2
    (tmp_path / "b_2000.txt").write_text("x::1\ny::2\n")
    got = read.csv_by_file(spark, str(tmp_path / "b_*.txt"), "k string, v int", "year", r"_(\d+)\.txt", "::")
    assert [tuple(r) for r in got.orderBy("k").collect()] == [("x", 1, "2000"), ("y", 2, "2000")]


def test_stream(spark, sf, tmp_path):
    from lumenframe.streaming import aggregates as A

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = A.read_stream(spark, str(tmp_path / "in"), e.schema).withColumn("one", F.lit(1).cast("bigint"))
    aggs = {"n": ("+", "one"), "hi": ("max", "value")}
    got = A.run_to_table(A.keyed(s, ["event_type"], aggs), "st_keyed", str(tmp_path / "c1"))
    want = A.keyed(e.withColumn("one", F.lit(1).cast("bigint")), ["event_type"], aggs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    w = A.run_to_table(A.windowed(s, "ts", "1 hour", "10 days", ["event_type"], aggs), "st_windowed", str(tmp_path / "c2"))
    assert w.agg(F.sum("n")).first()[0] == e.count()


def test_positional_sources(spark):
    assert [r.value for r in read.range_iter(spark, 0, 10, 3).orderBy("value").collect()] == [0, 3, 6]
    m = read.matrix(spark, np.arange(9).reshape(3, 3))
    assert [r.v for r in m.select(read.POS, V.dot(F.col("row"), [1.0, 2.0, 3.0]).alias("v")).orderBy(read.POS).collect()] == [8.0, 26.0, 44.0]
    assert "PushedFilters" in write.explain(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_totalprice > 5").select("o_orderkey"))
