"""The Series, Frame and Array surfaces against NumPy and pandas, and the cases the tables don't show."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays as V
from lumenframe.functions import scalar, udf
from lumenframe.functions import semantics as S
from lumenframe.operators import builders as B
from lumenframe.operators import relational as R
from lumenframe.operators.array import array, strided
from lumenframe.operators.frame import Frame, Series, evaluate_together
from lumenframe.settings import hinted, settings
from lumenframe.sources import read


def test_exact_products_and_wrapping_sums(spark):
    x = np.array([3] * 35)
    assert Series(x).agg("prod") == 3**35 == Series(x).prod()
    big = np.array([2**62] * 3 + [7])
    with np.errstate(over="ignore"):
        assert Series(big).agg("sum") == big.sum() and Series(big).agg(["prod", "sum"]).tolist() == [big.prod(), big.sum()]
    assert B.Merger({"p": ("*", "v", "int64"), "s": ("+", "v", "int64")}).add(spark.createDataFrame([(3,)] * 35, "v long")).result().first() == (3**35, 105)
    kv = spark.createDataFrame([(i % 3, 3, "x") for i in range(105)] + [(None, 5, "y"), (1, None, "z")], "k int, v long, t string").repartition(4)
    got = {r.k: (r.p, r.n) for r in B.DictMerger(["k"], {"p": ("*", "v"), "n": ("max", "t")}).add(kv).result().collect()}
    assert got == {0: (3**35, "x"), 1: (3**35, "z"), 2: (3**35, "x"), None: (5, "y")}
    assert {r.k: r.v for r in R.GroupBy(kv, "k", "v").prod().collect()}[2] == 3**35


def test_empty_series_give_identities(spark):
    e = Series(np.array([], np.int64))
    info = np.iinfo("int64")
    assert e.agg(["sum", "count", "prod"]).tolist() == [0, 0, 1] and e.agg(["min", "max"]).tolist() == [info.max, info.min]
    assert math.isnan(e.agg("mean") or math.nan) and Series(np.array([], np.int8)).agg("min") == 127
    assert math.isnan(R.GroupBy(spark.createDataFrame([(1, 2.0)], "k int, v double"), "k").std().first().v)


def test_masks_renumber(spark):
    f = Frame({"a": [1, 5, 2, 9], "b": ["w", "x", "y", "z"]})
    g = f[f["a"] > 2]
    assert g["a"][1] == 9 and g["a"][0:2].evaluate().tolist() == [5, 9] and g["b"].evaluate().tolist() == ["x", "z"]
    assert f[Series([True, False, False, True])]["b"].evaluate().tolist() == ["w", "z"]
    assert g.rows("b").count() == 2 and (g["a"] + g["a"]).evaluate().tolist() == [10, 18]
    g["c"] = g["a"] * 2
    assert g.evaluate()["c"].tolist() == [10, 18]
    assert (g["a"] + Series([1, 1])).evaluate().tolist() == [6, 10]
    assert f.assign_where("a", f["a"] > 2, 0).evaluate()["a"].tolist() == [1, 0, 2, 0]
    assert [list(r.row) for r in Frame({"x": [1, 2], "y": [0.5, 1.5]}).values(where=Series([False, True])).collect()] == [[2.0, 1.5]]
    a, b = evaluate_together(f["a"], Series([7, 8]))
    assert a.tolist() == [1, 5, 2, 9] and b.tolist() == [7, 8]


def test_zips_of_different_lengths_fail(spark):
    for run in (lambda: (Series([1, 2, 3]) + Series([1, 1])).evaluate(), lambda: (Series([1]) + Series([1, 1])).agg("sum"), lambda: Frame({"a": [1, 2]}).add(Frame({"a": [1]})).evaluate()):
        with pytest.raises(Exception, match="different lengths"):
            run()


def test_index_and_loc(spark):
    s = Series([10, 20, 30], index=["a", "b", "c"])
    assert s.loc[["c", "a"]].evaluate().to_dict() == {"a": 10, "c": 30} and s.index.evaluate().tolist() == ["a", "b", "c"]
    assert s.loc[Series(["b", "q"])].evaluate().tolist() == [20] and s[s > 10].evaluate().to_dict() == {"b": 20, "c": 30}
    assert Series([5, 6, 7]).loc[[2, 0]].evaluate().tolist() == [5, 7] and Series([5, 6]).index.evaluate().tolist() == [0, 1]
    assert s.sort_values().evaluate().to_dict() == {"c": 30, "b": 20, "a": 10}


def test_frame_operators(spark):
    p = pd.DataFrame({"a": [1, 2, 3], "b": [4.0, 5.0, 6.0]})
    f = Frame({"a": [1, 2, 3], "b": [4.0, 5.0, 6.0]})
    for op in ("__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__", "__mod__", "__add__", "__sub__", "__mul__", "__truediv__"):
        pd.testing.assert_frame_equal(getattr(f, op)(2).evaluate(), getattr(p, op)(2), check_dtype=False)
        pd.testing.assert_frame_equal(getattr(f, op)(Frame({"a": [3, 2, 1], "b": [5.0, 5.0, 5.0]})).evaluate(), getattr(p, op)(pd.DataFrame({"a": [3, 2, 1], "b": [5.0, 5.0, 5.0]})), check_dtype=False)
    f += 1
    assert f.evaluate()["a"].tolist() == [2, 3, 4]


def test_vecmerger_leaves_out_positions_outside(spark):
    base = read.from_columns(spark, {"value": [3, 3]})
    up = spark.createDataFrame([(0, 2), (7, 4), (-1, 9)], f"{read.POS} long, value long")
    for op, want in (("+", [5, 3]), ("*", [6, 3]), ("min", [2, 3]), ("max", [3, 3])):
        got = B.VecMerger(base, op).add(up).add(up.where("value > 100")).result()
        assert [r.value for r in got.orderBy(read.POS).collect()] == want and got.schema["value"].dataType == base.schema["value"].dataType
    u = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in ((2, 5), (0, 2), (9, 9), (0, 3))])
    assert spark.range(1).select(V.scatter(F.array(F.lit(1), F.lit(1), F.lit(1)), u, "+").alias("v")).first().v == [6, 1, 6]


def test_positions_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 3000)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "i": np.arange(3000)})).repartition(7)
    want = sorted(zip(values.tolist(), range(3000), strict=True))
    down = sorted(zip((-values).tolist(), range(3000), strict=True))
    for limit in (1_000_000, 100):
        monkeypatch.setattr(read, "ONE_TASK", limit)
        got = read.with_position(df, "v", ties=["i"]).orderBy(read.POS).collect()
        assert [(r.v, r.i, r[read.POS]) for r in got] == [(v, i, n) for n, (v, i) in enumerate(want)]
        got = read.with_position(df, "v", descending=True, ties=["i"]).orderBy(read.POS).collect()
        assert [(-r.v, r.i, r[read.POS]) for r in got] == [(v, i, n) for n, (v, i) in enumerate(down)]
    monkeypatch.setattr(read, "BLOCK", 4)
    at = spark.createDataFrame([(p, p) for p in (3, 700, 15, 16, 31, 32, 1000)], f"{read.POS} long, v long")
    assert [r.v for r in read.renumbered(at).orderBy(read.POS).collect()] == [3, 15, 16, 31, 32, 700, 1000]
    assert [r[0] for r in read.renumbered(at).select(read.POS).orderBy(read.POS).collect()] == list(range(7))


def test_arrays_like_numpy(spark):
    n = np.array([4.0, 1.0, 9.0, 16.0])
    a = array(n)
    np.testing.assert_allclose(np.asarray(np.sqrt(a) + a * 2 - 1), np.sqrt(n) + n * 2 - 1)
    np.testing.assert_allclose(np.asarray(2 / a), 2 / n)
    assert np.add.reduce(a) == 30 and np.multiply.reduce(array([2, 3, 7])) == 42 and a.max() == 16 and len(a) == 4
    assert np.asarray(a[[3, 0, 0]]).tolist() == [16, 4, 4] and a[-1] == 16 and np.asarray(a[a > 3]).tolist() == [4, 9, 16]
    np.testing.assert_allclose(np.hypot(a, a), np.hypot(n, n))  # no function of the engine's own
    v = a[1:3]
    v[0] = 100.0
    n[1] = 100.0
    assert np.asarray(a).tolist() == n.tolist() and np.asarray(v).tolist() == [100, 9]
    a[[0, 3, 0]] = [7.0, 8.0, 5.0]
    a[2:4] = array([1.5, 2.5])
    v += 1
    assert np.asarray(a).tolist() == [5, 101, 2.5, 2.5]
    np.add(a, 1, out=a)
    assert np.asarray(a).tolist() == [6, 102, 3.5, 3.5] and np.asarray(v).tolist() == [102, 3.5]


def test_strided_walk(spark):
    n = np.arange(60) * 10
    data = read.from_columns(spark, {"value": n})
    got = strided(data, 2, (3, 4), (20, 3)).orderBy(read.POS).collect()
    assert [r.value for r in got] == np.lib.stride_tricks.as_strided(n[2:], (3, 4), (160, 24)).ravel().tolist()
    assert [r.value for r in strided(data, 5, (2, 3), (0, -1)).orderBy(read.POS).collect()] == [50, 40, 30, 50, 40, 30]
    with pytest.raises(Exception, match="out of range"):
        strided(data, 50, (4,), (9,)).collect()


def test_erf_and_division(spark):
    x = [-7.0, -3.2, -1.0, -1e-9, 0.0, 0.3, 2.999, 3.0, 3.001, 5.5, 40.0, math.inf]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    np.testing.assert_allclose([r.e for r in df.select(scalar.erf(F.col("x")).alias("e")).collect()], [math.erf(v) for v in x], rtol=1e-14, atol=1e-16)
    r = spark.range(1).select(S.int_div(F.lit(-(2**63)), F.lit(-1)).alias("a"), S.int_div(F.lit(-7), F.lit(2)).alias("b"), S.int_div(F.lit(7), F.lit(-2)).alias("c")).first()
    assert (r.a, r.b, r.c) == (-(2**63), -3, -3)
    with pytest.raises(Exception, match="zero"):
        spark.range(1).select(S.int_div(F.lit(1), F.lit(0))).collect()
    r = spark.range(1).select(scalar.compare(F.lit("a"), F.lit("b")).alias("a"), V.sort_with(F.array(F.lit(1), F.lit(3), F.lit(2)), lambda a, b: scalar.compare(b, a)).alias("s")).first()
    assert r.a == -1 and r.s == [3, 2, 1]


def test_user_functions_and_settings(spark, tmp_path):
    add = udf.register(spark, "added", lambda a, b: a + b, "long")
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert [r.s for r in df.select(add("a", "b").alias("s")).collect()] == [3, 7] and spark.sql("SELECT added(5L, 6L)").first()[0] == 11
    with pytest.raises(KeyError):
        udf.call("nothing", "a")
    (tmp_path / "lumen_test_library.py").write_text("def triple(x):\n    return x * 3\n")
    udf.load_library(spark, str(tmp_path / "lumen_test_library.py"))

    def triple(x):
        import lumen_test_library

        return lumen_test_library.triple(x)

    udf.register(spark, "tripled", triple, "long")
    assert [r.t for r in df.select(udf.call("tripled", "b").alias("t")).collect()] == [6, 12]
    twice = udf.lazy(lambda c: c * 2)
    assert twice(Series([1, 2])).evaluate().tolist() == [2, 4] and df.select(twice(F.col("a")).alias("t")).first().t == 2
    with settings(spark, partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and hinted(df, 5).rdd.getNumPartitions() == 5
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    with pytest.raises(KeyError):
        settings(spark, nothing=1).__enter__()


def test_theta_needs_a_small_side(spark, monkeypatch):
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.range(5).withColumnRenamed("id", "y")
    assert R.theta(a, b, F.col("y") > F.col("x")).count() == 10
    monkeypatch.setattr(R, "NESTED", 3)
    with pytest.raises(ValueError):
        R.theta(a, b, F.col("y") > F.col("x"))


def test_builders_stored_between_runs(spark, tmp_path):
    kv = spark.createDataFrame([(1, 2), (2, 3), (1, 5)], "k int, v long")
    B.DictMerger(["k"], {"s": ("+", "v")}).add(kv).store(str(tmp_path / "state"))
    again = B.DictMerger(["k"], {"s": ("+", "v")}).resume(spark, str(tmp_path / "state")).add(kv)
    assert sorted(map(tuple, again.result().collect())) == [(1, 14), (2, 6)]
