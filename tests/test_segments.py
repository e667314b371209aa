"""Split layouts must give exactly what plain windows give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajmill import TrajectorySpec
from trajmill.operators import quality as Q, shaping as S
from trajmill.plans.segments import plan_layout, with_lags, with_position, with_running

SPEC = TrajectorySpec(case="c", time="t", states=("x",), inputs=("u",))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for case, n in (("hot", 300), ("a", 20), ("b", 5), (None, 40)):
        t = np.cumsum(rng.uniform(0.1, 2.0, n))
        rows += [(case, float(x), float(rng.normal()) if rng.random() > 0.1 else None, float(i))
                 for i, x in enumerate(t)]
    return spark.createDataFrame(rows, "c string, t double, x double, u double").repartition(7).cache()


def same(a, b):
    def rows(df):
        return sorted([tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                       for r in df.select(*sorted(df.columns)).collect()], key=repr)
    left, right = rows(a), rows(b)
    assert left == right
    assert left


def test_layout_splits_only_hot_cases(table):
    layout = plan_layout(table, ["c"], "t", 30)
    assert layout.split
    sizes = {(r["c"], r["_seg"]): r["count"] for r in layout.assign(table).groupBy("c", "_seg").count().collect()}
    assert max(sizes.values()) <= 60 and len([k for k in sizes if k[0] == "hot"]) >= 8
    assert [k for k in sizes if k[0] == "a"] == [("a", 0)]
    assert plan_layout(table, ["c"], "t", 1000).split is False


@pytest.mark.parametrize("target", [3, 30])
def test_lags_running_position(table, target):
    plain, cut = plan_layout(table, ["c"], "t"), plan_layout(table, ["c"], "t", target)
    assert cut.split
    for make in (
        lambda lay: with_lags(table, lay, ["t"], {"x1": ("x", 1), "u5": ("u", 5)}),
        lambda lay: with_running(table, lay, ["t"], last={"lx": F.col("x")}, total={"sx": F.col("x"), "n": F.lit(1)}),
        lambda lay: with_running(table, lay, ["t"], last={"lx": F.col("x")}, reverse=True),
        lambda lay: with_position(table, lay, ["t"]),
    ):
        same(make(cut), make(plain))


def test_operators_agree_on_split_layouts(table):
    rows = table.where("x is not null and c is not null")
    spec = SPEC
    same(S.resample_linear(rows, spec, 0.7, ["x", "u"], target_rows=20), S.resample_linear(rows, spec, 0.7, ["x", "u"]))
    same(Q.dt_summary(rows, spec, target_rows=20), Q.dt_summary(rows, spec))
    same(Q.large_gaps(rows, spec, 1.5, target_rows=20), Q.large_gaps(rows, spec, 1.5))
    shares = {"p50": 0.5, "p05": 0.05, "p95": 0.95}
    same(Q.percentiles(rows, ["c"], "x", shares, 20), Q.percentiles(rows, ["c"], "x", shares))
    asks = rows.select("c", (F.col("t") + 0.3).alias("ask"))
    for f in (lambda n: S.asof_backward(asks, rows, ["c"], "ask", "t", ["x", "u"], target_rows=n),
              lambda n: S.nearest_match(asks, rows, ["c"], "ask", "t", ["x"], 0.4, target_rows=n),
              lambda n: S.flags_at_time(asks, rows.withColumn("t", F.col("t") + 0.3), ["c"], "ask", "t",
                                        {"big": F.col("x") > 0.5, "low": F.col("x") < 0}, target_rows=n)):
        same(f(20), f(None))


def test_table_that_is_one_hot_case(table):
    rows = table.where("c = 'hot'").drop("c")
    plain, cut = plan_layout(rows, [], "t"), plan_layout(rows, [], "t", 40)
    assert cut.split
    same(with_lags(rows, cut, ["t"], {"x2": ("x", 2)}), with_lags(rows, plain, ["t"], {"x2": ("x", 2)}))
    same(with_position(rows, cut, ["t"]), with_position(rows, plain, ["t"]))
    same(Q.percentiles(rows, [], "t", {"m": 0.5}, 40), Q.percentiles(rows, [], "t", {"m": 0.5}))


def test_order_column_may_have_any_name(table):
    for name in ("_n", "_q", "_pieces"):
        rows = table.where("t is not null").select("c", F.col("t").alias(name), "x")
        for keys in ([], ["c"]):
            cut = plan_layout(rows, keys, name, 30)
            assert cut.split
            same(with_position(rows, cut, [name]), with_position(rows, plan_layout(rows, keys, name), [name]))


def test_one_time_holding_a_third_of_all_rows(spark):
    rows = [("a", 1.0, float(i), 0.0) for i in range(100)] + [("a", float(i), 1.0, 0.0) for i in range(2, 200)]
    df = spark.createDataFrame(rows, SPEC_SCHEMA)
    same(Q.dt_summary(df, SPEC, target_rows=10), Q.dt_summary(df, SPEC))
    layout = plan_layout(df, ["c"], "t", 10)
    assert layout.split
    asks = spark.createDataFrame([("a", 5.5)] * 100 + [("a", float(i)) for i in range(20)], "c string, ask double")
    same(S.asof_backward(asks, df.where("t > 1"), ["c"], "ask", "t", ["x"], target_rows=10),
         S.asof_backward(asks, df.where("t > 1"), ["c"], "ask", "t", ["x"]))


SPEC_SCHEMA = "c string, t double, x double, u double"
