"""Named queries over the shared test tables, with equivalent SQL where SQL can say it.

Views used as trajectories:

* events: case ``user_id``, time in seconds, state ``x`` (value), input ``u`` (``props.k``)
* supply: lineitem per supplier and month, states ``qty`` and ``rev`` (thousands), input ``disc``
* arrivals: orders of a customer in key order, as a live log whose time runs back and repeats
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill.functions.columns import seconds
from trajmill.operators import bias as B, fitting as fit, metrics as M, models as MT, monitoring as mon
from trajmill.operators import prediction as pred, quality as Q, selection as sel, shaping as S, status as ST
from trajmill.operators import summaries as SU, trees as TR
from trajmill.plans.segments import plan_layout, with_position
from trajmill.session import kept, settle, shared_folder
from trajmill.sources import archive as AR, tables as TB
from trajmill.spec import TrajectorySpec
from trajmill.streaming import buffer as BUF, inputs as IN, live as LIVE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return keep


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


# -- views ------------------------------------------------------------------------------------------

def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "user_id", "event_id", seconds("ts").alias("t"), F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("u"), "event_type")


def supply(spark, d) -> DataFrame:
    """Grouped once: fits, layouts and rollouts pass over the months, not over lineitem again."""
    month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    return kept(table(spark, d, "lineitem").groupBy("l_suppkey", seconds(month).alias("t")).agg(
        F.sum("l_quantity").alias("qty"), (F.sum("l_extendedprice") / 1000.0).alias("rev"), F.avg("l_discount").alias("disc")))


def split_supply(spark, d) -> DataFrame:
    return kept(S.split_by_fraction(supply(spark, d), "l_suppkey", 0.7))


def arrivals(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("_stream_row_index"),
        (seconds("o_orderdate") / 86400.0).alias("t"), (F.col("o_totalprice") / 1000.0).alias("price"))


EV = TrajectorySpec(case="user_id", time="t", states=("x",), inputs=("u",), order=("event_id",))
EV_FREE = TrajectorySpec(case="user_id", time="t", states=("x",), order=("event_id",))
SUP = TrajectorySpec(case="l_suppkey", time="t", states=("qty", "rev"), inputs=("disc",))
SUP_FREE = TrajectorySpec(case="l_suppkey", time="t", states=("qty", "rev"))
ARR = TrajectorySpec(case="cust", time="t", states=("price",))

ev_sql = """ev AS (SELECT user_id, event_id, epoch_us(ts)/1e6 AS t, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS u, event_type FROM events)"""
st_sql = ev_sql + """, st AS (SELECT * FROM (SELECT user_id, event_id, t, x, u, lead(x) OVER w AS x1, lead(t) OVER w - t AS dt,
  row_number() OVER w - 1 AS k FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE x1 IS NOT NULL)"""
rn_sql = ev_sql + """, rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k FROM ev)"""
sup_sql = """sup AS (SELECT l_suppkey, epoch_us(date_trunc('month', l_shipdate)::TIMESTAMP)/1e6 AS t, sum(l_quantity) AS qty,
  sum(l_extendedprice)/1000.0 AS rev, avg(l_discount) AS disc FROM lineitem GROUP BY 1, 2)"""
ss_sql = sup_sql + """, ss AS (SELECT * FROM (SELECT *, lead(qty) OVER w AS qty1, lead(rev) OVER w AS rev1
  FROM sup WINDOW w AS (PARTITION BY l_suppkey ORDER BY t)) WHERE qty1 IS NOT NULL)"""
dt_sql = ev_sql + """, d AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS dt,
  lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS tb, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev)"""


# -- sources and inspection --------------------------------------------------------------------------

def _profile_sql(name, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM {name}" for c in columns)


@query("import_column_profile", _profile_sql("events", ["event_id", "ts", "user_id", "event_type", "value", "props"]))
def import_column_profile(spark, d):
    return TB.column_profile(table(spark, d, "events")).drop("dtype")


@query("load_trajectories", f"WITH {ev_sql} SELECT user_id, event_id, round(t, 3) AS t, x, u FROM ev")
def load_trajectories(spark, d):
    return rounded(TB.load_trajectories(events(spark, d), EV, sort=False), 3, "t").select("user_id", "event_id", "t", "x", "u")


@query("table_summary", "SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT user_id) AS n_cases FROM events")
def table_summary(spark, d):
    return Q.table_summary(table(spark, d, "events"), TrajectorySpec(case="user_id", time="ts", states=("value",)))


@query("missing_values", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM events" for c in ("user_id", "ts", "value", "props")))
def missing_values(spark, d):
    return Q.missing_values(table(spark, d, "events"), ["user_id", "ts", "value", "props"])


@query("case_lengths", "SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1")
def case_lengths(spark, d):
    return Q.case_lengths(table(spark, d, "events"), "user_id")


@query("variance_by_column", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_pop({c}), 4) AS variance, round(stddev_pop({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")))
def variance_by_column(spark, d):
    return rounded(Q.variance_by_column(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), 4, "variance", "std")


@query("dt_summary", f"""WITH {dt_sql} SELECT CAST(user_id AS BIGINT) AS case_id, count(*) AS n_samples, round(min(t), 3) AS time_start, round(max(t), 3) AS time_end,
  round(quantile_cont(dt, 0.5) FILTER (dt > 0), 3) AS median_dt, round(min(dt), 3) AS min_dt, round(max(dt), 3) AS max_dt,
  round(stddev_pop(dt) FILTER (dt > 0), 2) AS dt_std, count(*) FILTER (dt = 0) AS duplicate_time_count FROM d GROUP BY 1""")
def dt_summary(spark, d):
    out = Q.dt_summary(events(spark, d), EV)
    return rounded(rounded(out, 3, "time_start", "time_end", "median_dt", "min_dt", "max_dt"), 2, "dt_std").select(
        "case_id", "n_samples", "time_start", "time_end", "median_dt", "min_dt", "max_dt", "dt_std", "duplicate_time_count")


@query("dt_uniformity", f"""WITH {sup_sql}, d AS (SELECT l_suppkey, t - lag(t) OVER (PARTITION BY l_suppkey ORDER BY t) AS dt FROM sup),
  m AS (SELECT l_suppkey, quantile_cont(dt, 0.5) AS med FROM d GROUP BY 1)
  SELECT l_suppkey AS case_id, max(abs(dt - med)) <= 1e-3 * greatest(abs(max(med)), 1.0) AS is_uniform,
  max(abs(dt - med)) > 1e-6 * greatest(abs(max(med)), 1.0) AS is_nonuniform FROM d JOIN m USING (l_suppkey) GROUP BY 1""")
def dt_uniformity(spark, d):
    s = Q.dt_summary(supply(spark, d), SUP)
    odd = Q.nonuniform_cases(s).select("case_id", F.lit(True).alias("is_nonuniform"))
    return s.select("case_id", "is_uniform").join(odd, "case_id", "left").fillna(False)


@query("large_gaps", f"""WITH {dt_sql}, m AS (SELECT user_id, quantile_cont(dt, 0.5) AS median_dt FROM d WHERE dt > 0 GROUP BY 1)
  SELECT d.user_id AS case_id, rn - 2 AS row_before_sorted, round(tb, 3) AS time_before, round(t, 3) AS time_after, round(dt, 3) AS dt,
  round(median_dt, 3) AS median_dt FROM d JOIN m ON d.user_id = m.user_id WHERE dt > 5 * median_dt""")
def large_gaps(spark, d):
    return rounded(Q.large_gaps(events(spark, d), EV), 3, "time_before", "time_after", "dt", "median_dt")


_quality_sql = f"""{ev_sql}, q AS (SELECT user_id, count(*) AS n_rows, min(t) AS t0, max(t) AS t1, arg_max(event_type, (t, event_id)) AS st,
  count(*) > count(DISTINCT t) AS dup FROM ev GROUP BY 1),
  p AS (SELECT user_id, n_rows, t0, t1, st, list_sort(list_filter([CASE WHEN n_rows < 60 THEN 'too_short' END,
  CASE WHEN dup THEN 'nonmonotonic_or_duplicate_time' END, CASE WHEN lower(st) NOT IN ('ok', 'success', 'succeeded', 'complete', 'completed')
  THEN 'status_not_success' END], lambda v: v IS NOT NULL)) AS problems FROM q)"""


@query("case_quality", f"""WITH {_quality_sql.replace("event_type, (t", "CASE WHEN event_type = 'purchase' THEN 'Success' ELSE event_type END, (t")}
  SELECT user_id AS case_id, n_rows, round(t0, 3) AS time_start, round(t1, 3) AS time_end, st AS explicit_status,
  array_to_string(problems, ';') AS problems, len(problems) = 0 AS usable_for_rom FROM p""")
def case_quality(spark, d):
    return rounded(_quality(spark, d), 3, "time_start", "time_end").select(
        "case_id", "n_rows", "time_start", "time_end", "explicit_status", "problems", "usable_for_rom")


def _quality(spark, d):
    rows = events(spark, d).withColumn("status", F.when(F.col("event_type") == "purchase", "Success").otherwise(F.col("event_type")))
    return Q.case_quality(rows, EV, required=["x", "u"], min_samples=60, status="status")


@query("usable_rows", f"""WITH {_quality_sql.replace("event_type, (t", "CASE WHEN event_type = 'purchase' THEN 'Success' ELSE event_type END, (t")}
  SELECT user_id, event_id, x FROM ev SEMI JOIN (SELECT user_id FROM p WHERE len(problems) = 0) USING (user_id)""")
def usable_rows(spark, d):
    return Q.filter_usable_cases(events(spark, d), _quality(spark, d), "user_id").select("user_id", "event_id", "x")


@query("quality_warnings", f"""WITH {dt_sql}, m AS (SELECT user_id, quantile_cont(dt, 0.5) AS med FROM d WHERE dt > 0 GROUP BY 1),
  g AS (SELECT user_id, count(*) AS n, max(abs(dt - med)) AS dev, max(med) AS med, count(*) FILTER (dt > 5 * med) AS gaps FROM d JOIN m USING (user_id) WHERE dt IS NOT NULL GROUP BY 1)
  SELECT 'IRREGULAR_TIME_STEP' AS code, CAST(user_id AS VARCHAR) AS subject, n + 1 AS count FROM g WHERE dev > 1e-3 * greatest(med, 1.0)
  UNION ALL SELECT 'LARGE_TIME_GAPS', CAST(user_id AS VARCHAR), gaps FROM g WHERE gaps > 0""")
def quality_warnings(spark, d):
    return Q.quality_warnings(events(spark, d), EV).select("code", "subject", "count")


@query("time_window", f"WITH {ev_sql} SELECT user_id, event_id, x FROM ev WHERE t BETWEEN 1704500000 AND 1705500000")
def time_window(spark, d):
    return Q.filter_time_window(events(spark, d), "t", 1704500000.0, 1705500000.0).select("user_id", "event_id", "x")


@query("describe_window", f"""WITH {ev_sql} SELECT count(*) AS rows_before, count(*) FILTER (t >= 1706000000) AS rows_after,
  count(DISTINCT user_id) AS cases_before, count(DISTINCT user_id) FILTER (t >= 1706000000) AS cases_after,
  round(min(t) FILTER (t >= 1706000000), 3) AS time_min_after, round(max(t), 3) AS time_max_after FROM ev""")
def describe_window(spark, d):
    return rounded(Q.describe_window(events(spark, d), EV, t_min=1706000000.0), 3, "time_min_after", "time_max_after")


@query("transient_steady", f"""WITH {ev_sql} SELECT user_id, CASE WHEN t < 1705000000 THEN 'transient' ELSE 'steady' END AS "window", count(*) AS n,
  round(avg(x), 6) AS mean_x FROM ev GROUP BY 1, 2""")
def transient_steady(spark, d):
    return Q.label_transient_steady(events(spark, d), "t", 1705000000.0).groupBy("user_id", "window").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean_x"))


# -- shaping ------------------------------------------------------------------------------------------

@query("transitions", f"WITH {st_sql} SELECT user_id, round(t, 3) AS t, x, u, x1 AS next_x, round(dt, 3) AS dt FROM st")
def transitions(spark, d):
    return rounded(S.transitions(events(spark, d), EV), 3, "t", "dt")


@query("slopes", f"WITH {st_sql} SELECT user_id, round(t, 3) AS t, round((x1 - x) / dt, 6) AS slope_x FROM st")
def slopes(spark, d):
    return S.slopes(events(spark, d), EV).select("user_id", r("t", 3).alias("t"), r("slope_x").alias("slope_x"))


@query("delay_embedding", f"""WITH {ev_sql} SELECT * FROM (SELECT user_id, event_id, u, x AS x__lag0, lag(x, 1) OVER w AS x__lag1, lag(x, 2) OVER w AS x__lag2
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE x__lag2 IS NOT NULL""")
def delay_embedding(spark, d):
    return S.delay_embedding(events(spark, d), EV, 3)[0].drop("t")


_bracket = """b AS (SELECT {key} tb, t, x AS x1, xb AS x0, t0, tn FROM (SELECT *, lag(t) OVER w AS tb, lag(x) OVER w AS xb,
  min(t) OVER ({part}) AS t0, max(t) OVER ({part}) AS tn FROM {src} WINDOW w AS ({part} ORDER BY t)) WHERE tb IS NOT NULL)"""


@query("resample_linear", f"""WITH {ev_sql}, {_bracket.format(key="user_id,", part="PARTITION BY user_id", src="ev")},
  g AS (SELECT user_id, t0, tn, unnest(generate_series(0, CAST(ceil((tn + 0.5 * 21600 - t0) / 21600) AS BIGINT) - 1)) AS i FROM (SELECT DISTINCT user_id, t0, tn FROM b)),
  p AS (SELECT user_id, tn, t0 + i * 21600.0 AS t FROM g)
  SELECT p.user_id, round(p.t, 3) AS t, round(b.x0 + least((p.t - b.tb) / (b.t - b.tb), 1.0) * (b.x1 - b.x0), 6) AS x
  FROM p JOIN b ON p.user_id = b.user_id AND ((p.t > b.tb AND p.t <= b.t) OR (p.t = b.t0 AND b.tb = b.t0) OR (p.t > b.tn AND b.t = b.tn))""")
def resample_linear(spark, d):
    return rounded(rounded(S.resample_linear(events(spark, d), EV, 21600.0, ["x"]), 3, "t"), 6, "x")


@query("resample_uniform", f"""WITH ev AS (SELECT epoch_us(o_orderdate)/1e6/86400 AS t, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE/1000 AS x FROM orders GROUP BY 1),
  {_bracket.format(key="", part="PARTITION BY 1", src="ev")},
  g AS (SELECT t0, tn, unnest(generate_series(0, CAST(ceil((tn + 0.5 * 0.7 - t0) / 0.7) AS BIGINT) - 1)) AS i FROM (SELECT DISTINCT t0, tn FROM b)),
  p AS (SELECT tn, t0 + i * 0.7 AS t FROM g)
  SELECT round(p.t, 6) AS t, round(b.x0 + least((p.t - b.tb) / (b.t - b.tb), 1.0) * (b.x1 - b.x0), 7) AS x
  FROM p JOIN b ON (p.t > b.tb AND p.t <= b.t) OR (p.t = b.t0 AND b.tb = b.t0) OR (p.t > b.tn AND b.t = b.tn)""")
def resample_uniform(spark, d):
    daily = table(spark, d, "orders").groupBy((seconds("o_orderdate") / 86400.0).alias("t")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000.0).alias("x"))
    return rounded(rounded(S.resample_uniform(daily, "t", 0.7, ["x"]), 6, "t"), 7, "x")


@query("asof_backward", f"""WITH {ev_sql}, l AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'error'), rr AS (SELECT user_id, t, x AS click_x FROM ev WHERE event_type = 'click')
  SELECT l.user_id, l.event_id, rr.click_x FROM l ASOF LEFT JOIN rr ON l.user_id = rr.user_id AND l.t >= rr.t""")
def asof_backward(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'error'").select("user_id", "event_id", "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("t").alias("click_t"), F.col("x").alias("click_x"))
    return S.asof_backward(left, right, ["user_id"], "t", "click_t", ["click_x"]).drop("t")


@query("nearest_match", f"""WITH {ev_sql}, c AS (SELECT l.user_id, l.event_id, rr.x AS view_x, abs(rr.t - l.t) AS gap,
  row_number() OVER (PARTITION BY l.event_id ORDER BY abs(rr.t - l.t), rr.t) AS n FROM ev l JOIN ev rr ON l.user_id = rr.user_id AND rr.event_type = 'view'
  AND abs(rr.t - l.t) <= 43200 WHERE l.event_type = 'purchase') SELECT user_id, event_id, view_x, round(gap, 3) AS time_error_s FROM c WHERE n = 1""")
def nearest_match(spark, d):
    e = events(spark, d)
    right = e.where("event_type = 'view'").select("user_id", F.col("t").alias("view_t"), F.col("x").alias("view_x"))
    hit = S.nearest_match(e.where("event_type = 'purchase'").select("user_id", "event_id", "t"), right, ["user_id"], "t", "view_t", ["view_x"], 43200.0)
    return hit.select("user_id", "event_id", "view_x", r("time_error_s", 3).alias("time_error_s"))


@query("flags_at_time", f"""WITH {ev_sql} SELECT event_id, EXISTS (SELECT 1 FROM ev o WHERE o.user_id = l.user_id AND o.event_type = 'error' AND abs(o.t - l.t) <= 21600) AS near_error,
  EXISTS (SELECT 1 FROM ev o WHERE o.user_id = l.user_id AND o.x > 100 AND abs(o.t - l.t) <= 21600) AS near_high FROM ev l WHERE event_type = 'signup'""")
def flags_at_time(spark, d):
    e = events(spark, d)
    right = e.select("user_id", F.col("t").alias("at"), "event_type", "x")
    return S.flags_at_time(e.where("event_type = 'signup'").select("user_id", "event_id", "t"), right, ["user_id"], "t", "at", {
        "near_error": F.col("event_type") == "error", "near_high": F.col("x") > 100}, tolerance=21600.0).select("event_id", "near_error", "near_high")


@query("split_fraction", """WITH c AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rk, count(*) OVER () AS n FROM c)
  SELECT user_id, CASE WHEN rk < greatest(1, least(round_even(n * 0.7, 0), n - 1)) THEN 'train' ELSE 'test' END AS split FROM n""")
def split_fraction(spark, d):
    return S.split_labels(S.distinct_cases(table(spark, d, "events"), "user_id"), "user_id", 0.7)


@query("split_case_ids", "SELECT 'train' AS side, count(*) AS n FROM events WHERE user_id IN (1, 2, 3) UNION ALL SELECT 'test', count(*) FROM events WHERE user_id IN (3, 4)")
def split_case_ids(spark, d):
    train, test = S.split_by_case_ids(table(spark, d, "events"), "user_id", [1, 2, 3], ["3", "4"])
    count = F.count(F.lit(1)).alias("n")
    return train.agg(F.lit("train").alias("side"), count).unionByName(test.agg(F.lit("test").alias("side"), count))


@query("leave_one_out_folds", """SELECT row_number() OVER (ORDER BY user_id) - 1 AS fold, user_id AS test_case, count(*) OVER () - 1 AS n_train_cases
  FROM (SELECT DISTINCT user_id FROM events)""")
def leave_one_out_folds(spark, d):
    return S.leave_one_case_out(table(spark, d, "events"), "user_id")


_split_sql = ev_sql + """, c AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ev)),
  sp AS (SELECT user_id, CASE WHEN rk < greatest(1, least(round_even(n * 0.7, 0), n - 1)) THEN 'train' ELSE 'test' END AS split FROM c)"""


def split_events(spark, d):
    return S.split_by_fraction(events(spark, d), "user_id", 0.7)


@query("operating_conditions", f"WITH {_split_sql}, j AS (SELECT * FROM ev JOIN sp USING (user_id)) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS condition, tr0 AS train_min, tr1 AS train_max, te0 AS test_min, te1 AS test_max, te0 < tr0 OR te1 > tr1 AS test_outside_train_range,
  round(te0 - tr0, 6) AS low_margin_test_minus_train_min, round(te1 - tr1, 6) AS high_margin_test_minus_train_max,
  CASE WHEN te0 < tr0 OR te1 > tr1 THEN 'extrapolation' ELSE 'interpolation_or_overlap' END AS status
  FROM (SELECT min({c}) FILTER (split = 'train') AS tr0, max({c}) FILTER (split = 'train') AS tr1, min({c}) FILTER (split = 'test') AS te0, max({c}) FILTER (split = 'test') AS te1 FROM j)""" for c in ("x", "u")))
def operating_conditions(spark, d):
    return rounded(S.operating_conditions(split_events(spark, d), "split", ["x", "u"]), 6, "low_margin_test_minus_train_min", "high_margin_test_minus_train_max")


# -- fits -----------------------------------------------------------------------------------------------

_ar = "(SELECT sum(x * x1) / sum(x * x) AS a FROM st)"
_arx = """cf AS (SELECT (s1x * suu - s1u * sxu) / (sxx * suu - sxu * sxu) AS a, (s1u * sxx - s1x * sxu) / (sxx * suu - sxu * sxu) AS b, n, s11, s1x, s1u, sxx, sxu, suu
  FROM (SELECT sum(x * x) AS sxx, sum(x * u) AS sxu, sum(u * u) AS suu, sum(x1 * x) AS s1x, sum(x1 * u) AS s1u, sum(x1 * x1) AS s11, count(*) AS n FROM st))"""


def coefficients(spark, model: fit.LinearModel) -> DataFrame:
    rows = [(s, c, float(v)) for i, s in enumerate(model.states)
            for c, v in zip([*model.states, *model.inputs], [*model.a[i], *model.b[i]])]
    return rounded(spark.createDataFrame(rows, "target string, source string, coefficient double"), 6, "coefficient")


def arx(spark, d) -> fit.LinearModel:
    return fit.fit_dmdc(fit.fit_transitions(events(spark, d), EV), EV)


def ar(spark, d) -> fit.LinearModel:
    return fit.fit_dmdc(fit.fit_transitions(events(spark, d), EV_FREE), EV_FREE)


@query("dmdc_per_case", f"""WITH {st_sql}, s AS (SELECT user_id, count(*) AS n_transitions, sum(x * x1) / sum(x * x) AS a FROM st GROUP BY 1)
  SELECT user_id, n_transitions, round(a, 6) AS a, round(sqrt(avg((x1 - s.a * x) ** 2)), 6) AS one_step_rmse FROM st JOIN s USING (user_id) GROUP BY ALL""")
def dmdc_per_case(spark, d):
    out = fit.models_per_case(fit.case_factors(events(spark, d), EV_FREE), EV_FREE)
    return out.select("user_id", "n_transitions", r(F.col("a")[0][0]).alias("a"), r("one_step_rmse").alias("one_step_rmse"))


@query("continuous_rates_per_case", f"""WITH {st_sql}, s AS (SELECT user_id, sum(x * x1) / sum(x * x) AS a, quantile_cont(dt, 0.5) / 3600 AS dt FROM st GROUP BY 1)
  SELECT user_id, round(ln(abs(a)) / dt, 6) AS growth_rate FROM s""")
def continuous_rates_per_case(spark, d):
    e = events(spark, d)
    steps = Q.dt_summary(e, EV).select(F.col("case_id").alias("user_id"), (F.col("median_dt") / 3600.0).alias("median_dt"))
    out = fit.models_per_case(fit.case_factors(e, EV_FREE), EV_FREE, dt=steps)
    return out.select("user_id", r("growth_rate").alias("growth_rate"))


@query("dmdc_pooled", f"""WITH {st_sql}, {_arx} SELECT 'x' AS target, 'x' AS source, round(a, 6) AS coefficient FROM cf UNION ALL SELECT 'x', 'u', round(b, 6) FROM cf""")
def dmdc_pooled(spark, d):
    return coefficients(spark, arx(spark, d))


@query("ridge_pooled", f"WITH {st_sql} SELECT 'x' AS target, 'x' AS source, round(sum(x * x1) / (sum(x * x) + 1e6), 6) AS coefficient FROM st")
def ridge_pooled(spark, d):
    return coefficients(spark, fit.fit_ridge(fit.fit_transitions(events(spark, d), EV_FREE), EV_FREE, alpha=1e6))


@query("adaptive_pooled", f"""WITH {st_sql} SELECT round(sum(x * (x1 - x) / (dt / 3600)) / sum(x * x), 6) AS a, round(quantile_cont(dt / 3600, 0.5), 6) AS median_dt,
  round(min(dt / 3600), 6) AS min_dt, round(max(dt / 3600), 6) AS max_dt FROM st""")
def adaptive_pooled(spark, d):
    hours = events(spark, d).withColumn("t", F.col("t") / 3600.0)
    m = fit.fit_adaptive(hours, EV_FREE, alpha=0.0)
    row = (float(m.a[0, 0]), m.metadata["median_dt"], m.metadata["min_dt"], m.metadata["max_dt"])
    return rounded(spark.createDataFrame([row], "a double, median_dt double, min_dt double, max_dt double"), 6, "a", "median_dt", "min_dt", "max_dt")


def _cramer(y):
    return f"(sum({y} * qty) * sum(rev * rev) - sum({y} * rev) * sum(qty * rev)) / (sum(qty * qty) * sum(rev * rev) - sum(qty * rev) ** 2)"


def _cramer2(y):
    return f"(sum({y} * rev) * sum(qty * qty) - sum({y} * qty) * sum(qty * rev)) / (sum(qty * qty) * sum(rev * rev) - sum(qty * rev) ** 2)"


@query("dmd_two_states", f"WITH {ss_sql} " + " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{s}' AS source, round({f(t + '1')}, 6) AS coefficient FROM ss" for t in ("qty", "rev") for s, f in (("qty", _cramer), ("rev", _cramer2))))
def dmd_two_states(spark, d):
    return coefficients(spark, fit.fit_dmdc(fit.fit_transitions(supply(spark, d), SUP_FREE), SUP_FREE))


@query("dmdc_centered", f"""WITH {ss_sql}, m AS (SELECT avg(qty) AS mq, avg(rev) AS mr FROM ss), z AS (SELECT qty - mq AS qty, rev - mr AS rev, qty1 - mq AS qty1, rev1 - mr AS rev1 FROM ss, m) """ + " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{s}' AS source, round({f(t + '1')}, 6) AS coefficient FROM z" for t in ("qty", "rev") for s, f in (("qty", _cramer), ("rev", _cramer2))))
def dmdc_centered(spark, d):
    return coefficients(spark, fit.fit_dmdc(fit.fit_transitions(supply(spark, d), SUP_FREE), SUP_FREE, center=True, scale=True))


@query("graph_masked", f"""WITH {ss_sql} SELECT 'qty' AS target, 'qty' AS source, round(sum(qty * qty1) / sum(qty * qty), 6) AS coefficient FROM ss
  UNION ALL SELECT 'qty', 'rev', 0.0::DOUBLE UNION ALL SELECT 'rev', 'qty', 0.0::DOUBLE UNION ALL SELECT 'rev', 'rev', round(sum(rev * rev1) / sum(rev * rev), 6) FROM ss""")
def graph_masked(spark, d):
    return coefficients(spark, fit.fit_graph(fit.fit_transitions(supply(spark, d), SUP_FREE), SUP_FREE, [("qty", "qty"), ("rev", "rev")]))


@query("pod_energies", f"""WITH {sup_sql}, c AS (SELECT var_pop(qty) AS a, covar_pop(qty, rev) AS b, var_pop(rev) AS c, count(*) AS m FROM sup),
  l AS (SELECT m, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM c)
  SELECT 1 AS mode, round(sqrt(m * l1), 3) AS singular_value, round(l1 / (l1 + l2), 6) AS explained_energy, round(l1 / (l1 + l2), 6) AS cumulative_energy FROM l
  UNION ALL SELECT 2, round(sqrt(m * l2), 3), round(l2 / (l1 + l2), 6), 1.0::DOUBLE FROM l""")
def pod_energies(spark, d):
    pod = fit.fit_pod(fit.fit_snapshots(supply(spark, d), SUP.states), SUP.states)
    out = spark.createDataFrame(pod.energies())
    return rounded(rounded(out, 3, "singular_value"), 6, "explained_energy", "cumulative_energy").withColumn("mode", F.col("mode").cast("int"))


def embeddings(spark, d) -> tuple[DataFrame, list[str]]:
    raw = table(spark, d, "embeddings")
    least, width = raw.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != width:
        raise ValueError(f"embeddings have {least} to {width} numbers")
    names = [f"e{i}" for i in range(width)]
    return raw.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("pod_embeddings_energy", """WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
  SELECT round(sum(v2), 4) AS total_energy, max(n) AS n_snapshots, count(*) AS n_modes FROM (SELECT i, var_pop(v) * count(*) AS v2, count(*) AS n FROM l GROUP BY i)""")
def pod_embeddings_energy(spark, d):
    df, names = embeddings(spark, d)
    pod = fit.fit_pod(fit.fit_snapshots(df, names), names)
    row = (float((pod.singular_values**2).sum()), pod.rows, len(pod.singular_values))
    return rounded(spark.createDataFrame([row], "total_energy double, n_snapshots bigint, n_modes bigint"), 4, "total_energy")


@query("pod_embeddings_error_curve")
def pod_embeddings_error_curve(spark, d):
    df, names = embeddings(spark, d)
    factor = fit.fit_snapshots(df, names)
    return spark.createDataFrame(fit.reconstruction_curve(factor, fit.fit_pod(factor, names)))


@query("pod_reconstruction", f"""WITH {sup_sql}, c AS (SELECT avg(qty) AS mq, avg(rev) AS mr, var_pop(qty) AS a, covar_pop(qty, rev) AS b, var_pop(rev) AS c FROM sup),
  e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1 FROM c), v AS (SELECT mq, mr, b / sqrt(b * b + (l1 - a) ** 2) AS v1, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS v2 FROM e)
  SELECT l_suppkey, t, round(mq + v1 * (v1 * (qty - mq) + v2 * (rev - mr)), 4) AS rec_qty, round(mr + v2 * (v1 * (qty - mq) + v2 * (rev - mr)), 4) AS rec_rev FROM sup, v""")
def pod_reconstruction(spark, d):
    df = supply(spark, d)
    pod = fit.fit_pod(fit.fit_snapshots(df, SUP.states), SUP.states, rank=1)
    return rounded(pred.pod_inverse(pred.pod_transform(df, pod), pod), 4, "rec_qty", "rec_rev").select("l_suppkey", "t", "rec_qty", "rec_rev")


@query("pod_dmdc_one_step", None)
def pod_dmdc_one_step(spark, d):
    df = supply(spark, d)
    model = fit.fit_pod_dmdc(fit.fit_transitions(df, SUP), fit.fit_snapshots(df, SUP.states), SUP, pod_rank=1)
    return pred.predict_one_step(df, model)


@query("pod_ridge_rollout", None)
def pod_ridge_rollout(spark, d):
    df = supply(spark, d)
    model = fit.fit_pod_ridge(fit.fit_transitions(df, SUP), fit.fit_snapshots(df, SUP.states), SUP, pod_rank=2)
    return pred.rollout(df, SUP, model)


@query("sensor_ranking", None)
def sensor_ranking(spark, d):
    df, names = embeddings(spark, d)
    factor = fit.fit_snapshots(df, names)
    pod = fit.fit_pod(factor, names, rank=8)
    order = fit.sensor_ranking(pod)
    curve = M.sensor_error_curve(factor, pod, order["sensor_index"].tolist(), 8)
    return spark.createDataFrame(order.merge(curve, left_on="rank", right_on="n_sensors", how="left"))


@query("sensor_reconstruction", None)
def sensor_reconstruction(spark, d):
    df, names = embeddings(spark, d)
    pod = fit.fit_pod(fit.fit_snapshots(df, names), names, rank=8)
    chosen = fit.sensor_ranking(pod)["sensor_index"].tolist()[:8]
    return M.error_by_column(pred.reconstruct_from_sensors(df, pod, chosen), {c: f"rec_{c}" for c in names})


@query("tree_one_step", None)
def tree_one_step(spark, d):
    df = supply(spark, d)
    pod = fit.fit_pod(fit.fit_snapshots(df, SUP.states), SUP.states, rank=1)
    model = TR.fit_tree_model(S.transitions(df, SUP), SUP, pod)
    return TR.predict_next_trees(df, SUP, model).select("l_suppkey", "t", "pred_qty", "pred_rev")


@query("tree_rollout", None)
def tree_rollout(spark, d):
    df = supply(spark, d)
    pod = fit.fit_pod(fit.fit_snapshots(df, SUP.states), SUP.states, rank=1)
    return TR.rollout_trees(df, SUP, TR.fit_tree_model(S.transitions(df, SUP), SUP, pod, trees=20)).drop("_k")


@query("compare_tree_models", None)
def compare_tree_models(spark, d):
    df = split_supply(spark, d)
    return sel.compare_models(df, SUP, ["persistence", "pod_dmdc", "pod_ml_random_forest", "pod_ml_gb"], trees=10)[0]


# -- prediction and scores ----------------------------------------------------------------------------------

@query("predict_one_step", f"WITH {st_sql}, {_arx} SELECT user_id, event_id, round(a * ev.x + b * ev.u, 6) AS pred_x FROM ev, cf")
def predict_one_step(spark, d):
    e = events(spark, d)
    return pred.predict_one_step(e, arx(spark, d)).select("user_id", "event_id", r("pred_x").alias("pred_x"))


@query("one_step_rmse", f"WITH {st_sql}, {_arx} SELECT user_id, round(sqrt(avg((x1 - a * x - b * u) ** 2)), 6) AS one_step_rmse, count(*) AS n_transitions FROM st, cf GROUP BY 1")
def one_step_rmse(spark, d):
    e = events(spark, d)
    steps = pred.predict_one_step(S.transitions(e, EV), arx(spark, d))
    return rounded(M.one_step_rmse(steps, EV, by=["user_id"]), 6, "one_step_rmse")


_roll = f"""{rn_sql}, st AS (SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY k) AS x1 FROM rn) WHERE x1 IS NOT NULL), {_arx},
  ro AS (SELECT user_id, k, x AS p FROM rn WHERE k = 0 UNION ALL SELECT n.user_id, n.k, cf.a * ro.p + cf.b * o.u FROM ro JOIN rn n ON n.user_id = ro.user_id AND n.k = ro.k + 1
  JOIN rn o ON o.user_id = ro.user_id AND o.k = ro.k, cf)"""


@query("rollout", f"WITH RECURSIVE {_roll} SELECT rn.user_id, rn.event_id, round(p, 6) AS pred_x FROM ro JOIN rn USING (user_id, k)")
def rollout(spark, d):
    return pred.rollout(events(spark, d), EV, arx(spark, d)).select("user_id", "event_id", r("pred_x").alias("pred_x"))


_slope = lambda f, y: f(f"(({y}1 - {y}) / dt)")
_months = f"""{sup_sql}, mo AS (SELECT l_suppkey, t / 2592000.0 AS t, qty, rev, row_number() OVER (PARTITION BY l_suppkey ORDER BY t) - 1 AS k,
  (t - lag(t) OVER (PARTITION BY l_suppkey ORDER BY t)) / 2592000.0 AS back FROM sup),
  sl AS (SELECT * FROM (SELECT qty, rev, lead(qty) OVER w AS qty1, lead(rev) OVER w AS rev1, lead(t) OVER w - t AS dt FROM mo WINDOW w AS (PARTITION BY l_suppkey ORDER BY k)) WHERE dt IS NOT NULL),
  rate AS (SELECT {_slope(_cramer, "qty")} AS a11, {_slope(_cramer2, "qty")} AS a12, {_slope(_cramer, "rev")} AS a21, {_slope(_cramer2, "rev")} AS a22 FROM sl),
  half AS (SELECT *, (a11 + a22) / 2 AS s, (a11 - a22) / 2 AS h, ((a11 - a22) / 2) ** 2 + a12 * a21 AS disc FROM rate),
  hold AS (SELECT l_suppkey, k, exp(s * back) * (CASE WHEN disc >= 0 THEN cosh(sqrt(disc) * back) ELSE cos(sqrt(-disc) * back) END) AS c,
    exp(s * back) * (CASE WHEN disc >= 0 THEN sinh(sqrt(disc) * back) / sqrt(disc) ELSE sin(sqrt(-disc) * back) / sqrt(-disc) END) AS z, h, a12, a21 FROM mo, half WHERE k > 0),
  vr AS (SELECT l_suppkey, k, qty AS p, rev AS q FROM mo WHERE k = 0 UNION ALL SELECT e.l_suppkey, e.k, (e.c + e.z * e.h) * vr.p + e.z * e.a12 * vr.q, e.z * e.a21 * vr.p + (e.c - e.z * e.h) * vr.q
    FROM vr JOIN hold e ON e.l_suppkey = vr.l_suppkey AND e.k = vr.k + 1)"""


@query("variable_step_rollout", f"WITH RECURSIVE {_months} SELECT mo.l_suppkey, round(mo.t, 6) AS t, round(p, 4) AS pred_qty, round(q, 4) AS pred_rev FROM vr JOIN mo ON mo.l_suppkey = vr.l_suppkey AND mo.k = vr.k")
def variable_step_rollout(spark, d):
    """Two states over months of 28 to 31 days: a matrix exponential per step."""
    df = supply(spark, d).withColumn("t", F.col("t") / 2592000.0)
    out = pred.rollout(df, SUP_FREE, fit.fit_adaptive(df, SUP_FREE, alpha=0.0))
    return rounded(rounded(out, 6, "t"), 4, "pred_qty", "pred_rev").select("l_suppkey", "t", "pred_qty", "pred_rev")


@query("rollout_evaluation", f"""WITH RECURSIVE {_roll}, e AS (SELECT rn.user_id, x, p FROM ro JOIN rn USING (user_id, k))
  SELECT user_id, 'case' AS level, round(sqrt(avg((x - p) ** 2)), 6) AS rollout_rmse, round(sqrt(sum((x - p) ** 2)) / sqrt(sum(x * x)), 6) AS rollout_relative_error, count(*) AS n_values FROM e GROUP BY 1
  UNION ALL SELECT NULL, 'pooled', round(sqrt(avg((x - p) ** 2)), 6), round(sqrt(sum((x - p) ** 2)) / sqrt(sum(x * x)), 6), count(*) FROM e""")
def rollout_evaluation(spark, d):
    return rounded(M.evaluate_trajectories(pred.rollout(events(spark, d), EV, arx(spark, d)), EV), 6, "rollout_rmse", "rollout_relative_error")


@query("horizon_errors", f"""WITH RECURSIVE {_roll}, e AS (SELECT user_id, k, (x - p) ** 2 AS s FROM ro JOIN rn USING (user_id, k))
  SELECT user_id, h AS horizon, round(sqrt(avg(s)), 6) AS tail_rmse, round(sqrt(avg(s) FILTER (k = h)), 6) AS exact_rmse, count(*) AS n_rows FROM e, (VALUES (1), (5), (10), (60)) v(h) WHERE k >= h GROUP BY 1, 2""")
def horizon_errors(spark, d):
    return rounded(M.horizon_errors(pred.rollout(events(spark, d), EV, arx(spark, d)), EV, (1, 5, 10, 60)), 6, "tail_rmse", "exact_rmse")


@query("error_by_column", f"""WITH RECURSIVE {_roll}, e AS (SELECT x, p FROM ro JOIN rn USING (user_id, k))
  SELECT 'x' AS "column", round(sqrt(avg((x - p) ** 2)), 6) AS rmse, round(avg(abs(x - p)), 6) AS mae, round(max(abs(x - p)), 6) AS max_abs, round(avg(x - p), 6) AS bias,
  round(sqrt(sum((x - p) ** 2)) / sqrt(sum(x * x)), 6) AS relative_error FROM e""")
def error_by_column(spark, d):
    out = M.error_by_column(pred.rollout(events(spark, d), EV, arx(spark, d)), {"x": "pred_x"})
    return rounded(out, 6, "rmse", "mae", "max_abs", "bias", "relative_error")


@query("persistence_rollout", f"WITH {rn_sql} SELECT user_id, event_id, first_value(x) OVER (PARTITION BY user_id ORDER BY k) AS pred_x FROM rn")
def persistence_rollout(spark, d):
    return pred.rollout_persistence(events(spark, d), EV).select("user_id", "event_id", "pred_x")


@query("mean_rollout", f"WITH {rn_sql} SELECT user_id, event_id, CASE WHEN k = 0 THEN x ELSE round((SELECT avg(x) FROM ev), 6) END AS pred_x FROM rn")
def mean_rollout(spark, d):
    e = events(spark, d)
    return pred.rollout_persistence(e, EV, mean=fit.fit_mean(e, ["x"])).select("user_id", "event_id", r("pred_x").alias("pred_x"))


_compare = f"""{_split_sql}, rn AS (SELECT ev.*, split, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k FROM ev JOIN sp USING (user_id)),
  st AS (SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY k) AS x1 FROM rn) WHERE x1 IS NOT NULL AND split = 'train'),
  m AS (SELECT (SELECT sum(x * x1) / sum(x * x) FROM st) AS a, (SELECT avg(x) FROM rn WHERE split = 'train') AS mu),
  z AS (SELECT user_id, split, x, k, first_value(x) OVER (PARTITION BY user_id ORDER BY k) AS x0 FROM rn),
  p AS (SELECT split, x, 'dmd' AS model_name, x0 * pow(a, k) AS p FROM z, m UNION ALL SELECT split, x, 'persistence', x0 FROM z UNION ALL SELECT split, x, 'mean', CASE WHEN k = 0 THEN x0 ELSE mu END FROM z, m),
  e AS (SELECT model_name, sqrt(avg((x - p) ** 2) FILTER (split = 'train')) AS tr, sqrt(avg((x - p) ** 2) FILTER (split = 'test')) AS te FROM p GROUP BY 1)"""


@query("compare_models", f"""WITH {_compare} SELECT model_name, round(tr, 6) AS train_rmse, round(te, 6) AS test_rmse, round(te - tr, 6) AS generalization_gap,
  round(te / tr, 6) AS generalization_ratio, te / tr > 5 AS gap_warning FROM e""")
def compare_models(spark, d):
    out, _ = sel.compare_models(split_events(spark, d), EV, ["persistence", "mean", "dmd"])
    return rounded(out, 6, "train_rmse", "test_rmse", "generalization_gap", "generalization_ratio").select(
        "model_name", "train_rmse", "test_rmse", "generalization_gap", "generalization_ratio", "gap_warning")


@query("recommend_model", f"WITH {_compare} SELECT model_name, round(te, 6) AS test_rmse, FALSE AS used_fallback, 'ok' AS recommendation_status FROM e ORDER BY te LIMIT 1")
def recommend_model(spark, d):
    out, _ = sel.compare_models(split_events(spark, d), EV, ["persistence", "mean", "dmd"])
    return rounded(sel.recommend(out).select("model_name", "test_rmse", "used_fallback", "recommendation_status"), 6, "test_rmse")


@query("compare_all_models", None)
def compare_all_models(spark, d):
    df = split_supply(spark, d)
    return sel.compare_models(df, SUP, ["persistence", "mean", "dmdc", "ridge_dmdc", "pod_dmdc", "pod_ml"])[0]


@query("leave_one_out", f"""WITH {st_sql}, s AS (SELECT user_id, sum(x * x) AS s00, sum(x * x1) AS s01, sum(x1 * x1) AS s11, count(*) AS n FROM st GROUP BY 1),
  t AS (SELECT sum(s00) AS s00, sum(s01) AS s01, sum(s11) AS s11, sum(n) AS n FROM s), f AS (SELECT s.*, (t.s01 - s.s01) / (t.s00 - s.s00) AS a, t.s00 - s.s00 AS o00, t.s01 - s.s01 AS o01, t.s11 - s.s11 AS o11, t.n - s.n AS o FROM s, t)
  SELECT user_id, CAST(o AS BIGINT) AS n_train, round(sqrt((o11 - 2 * a * o01 + a * a * o00) / o), 6) AS train_rmse, round(sqrt((s11 - 2 * a * s01 + a * a * s00) / n), 6) AS test_rmse FROM f""")
def leave_one_out(spark, d):
    return rounded(sel.leave_one_out_scores(events(spark, d), EV_FREE), 6, "train_rmse", "test_rmse")


@query("rank_delay_sweep", None)
def rank_delay_sweep(spark, d):
    df = split_supply(spark, d)
    return sel.rank_delay_sweep(df, SUP, models=("dmdc", "pod_dmdc"), pod_ranks=(1, 2), dmdc_ranks=(1, None), delays=(1, 2))


@query("bootstrap_interval", None)
def bootstrap_interval(spark, d):
    steps = S.transitions(events(spark, d), EV).withColumn("change", F.abs(F.col("next_x") - F.col("x")))
    per_case = steps.groupBy("user_id").agg(F.avg("change").alias("change"))
    return sel.bootstrap_ci(per_case.withColumn("band", F.pmod("user_id", F.lit(3))), ["band"], "change")


_kal = f"""{rn_sql}, st AS (SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY k) AS x1 FROM rn) WHERE x1 IS NOT NULL), cf AS {_ar},
  kf AS (SELECT user_id, k, x / (1 + 0.1) AS s, 1 - 1 / 1.1 AS p, x AS inn FROM rn WHERE k = 0
  UNION ALL SELECT n.user_id, n.k, cf.a * kf.s + (cf.a * cf.a * kf.p + 0.01) / (cf.a * cf.a * kf.p + 0.11) * (n.x - cf.a * kf.s),
  (1 - (cf.a * cf.a * kf.p + 0.01) / (cf.a * cf.a * kf.p + 0.11)) * (cf.a * cf.a * kf.p + 0.01), n.x - cf.a * kf.s FROM kf JOIN rn n ON n.user_id = kf.user_id AND n.k = kf.k + 1, cf)"""


@query("kalman_filter", f"""WITH RECURSIVE {_kal} SELECT user_id, event_id, round(s, 6) AS est_x, round(p, 9) AS covariance_trace, round(inn, 6) AS innovation_x FROM kf JOIN rn USING (user_id, k)""")
def kalman_filter(spark, d):
    out = pred.kalman_filter(events(spark, d), EV_FREE, ar(spark, d), ["x"], np.eye(1), q=np.eye(1) * 0.01, r=np.eye(1) * 0.1)
    return out.select("user_id", "event_id", r("est_x").alias("est_x"), r("covariance_trace", 9).alias("covariance_trace"), r("innovation_x").alias("innovation_x"))


_kal2 = f"""{ss_sql}, cf AS (SELECT {_cramer("qty1")} AS a11, {_cramer2("qty1")} AS a12, {_cramer("rev1")} AS a21, {_cramer2("rev1")} AS a22 FROM ss),
  rn AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY t) - 1 AS k FROM sup), top AS (SELECT max(k) AS top FROM rn),
  gp AS (SELECT 0::BIGINT AS k, 1 / 1.1 AS g1, 0.0::DOUBLE AS g2, 1 - 1 / 1.1 AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22
    UNION ALL SELECT k + 1, m11 / (m11 + 0.1), m12 / (m11 + 0.1), (1 - m11 / (m11 + 0.1)) * m11, (1 - m11 / (m11 + 0.1)) * m12, m22 - m12 * m12 / (m11 + 0.1)
    FROM (SELECT k, a11 * a11 * p11 + 2 * a11 * a12 * p12 + a12 * a12 * p22 + 0.01 AS m11, a11 * a21 * p11 + (a11 * a22 + a12 * a21) * p12 + a12 * a22 * p22 AS m12,
      a21 * a21 * p11 + 2 * a21 * a22 * p12 + a22 * a22 * p22 + 0.01 AS m22 FROM gp, cf, top WHERE k < top)),
  kf AS (SELECT l_suppkey, k, g1 * qty AS x1, g2 * qty AS x2, qty AS inn FROM rn JOIN gp USING (k) WHERE k = 0
    UNION ALL SELECT n.l_suppkey, n.k, a11 * x1 + a12 * x2 + g1 * (qty - a11 * x1 - a12 * x2), a21 * x1 + a22 * x2 + g2 * (qty - a11 * x1 - a12 * x2), qty - a11 * x1 - a12 * x2
    FROM kf JOIN rn n ON n.l_suppkey = kf.l_suppkey AND n.k = kf.k + 1 JOIN gp ON gp.k = n.k, cf)"""


@query("kalman_two_states", f"WITH RECURSIVE {_kal2} SELECT l_suppkey, k, round(x1, 5) AS est_qty, round(x2, 5) AS est_rev, round(p11 + p22, 6) AS covariance_trace, round(inn, 5) AS innovation_qty FROM kf JOIN gp USING (k)")
def kalman_two_states(spark, d):
    """One of two states is measured; the other's estimate comes from the dynamics."""
    df = supply(spark, d)
    model = fit.fit_dmdc(fit.fit_transitions(df, SUP_FREE), SUP_FREE)
    out = pred.kalman_filter(df, SUP_FREE, model, ["qty"], np.array([[1.0, 0.0]]), q=np.eye(2) * 0.01, r=np.eye(1) * 0.1)
    return rounded(rounded(with_position(out, plan_layout(out, ["l_suppkey"], "t"), ["t"], "k"), 5, "est_qty", "est_rev", "innovation_qty"), 6, "covariance_trace").select(
        "l_suppkey", F.col("k").cast("bigint").alias("k"), "est_qty", "est_rev", "covariance_trace", "innovation_qty")


# One mode of two states: its direction, the modal fit z1 = a z + b u and the filter of qty are closed forms.
_mode = f"""{sup_sql}, c0 AS (SELECT avg(qty) AS mq, avg(rev) AS mr, var_pop(qty) AS va, covar_pop(qty, rev) AS vb, var_pop(rev) AS vc FROM sup),
  e0 AS (SELECT *, (va + vc) / 2 + sqrt(((va - vc) / 2) ** 2 + vb * vb) AS l1 FROM c0),
  v AS (SELECT mq, mr, vb / sqrt(vb * vb + (l1 - va) ** 2) AS v1, (l1 - va) / sqrt(vb * vb + (l1 - va) ** 2) AS v2 FROM e0),
  zz AS (SELECT l_suppkey, t, qty, rev, disc, v1 * (qty - mq) + v2 * (rev - mr) AS z, row_number() OVER (PARTITION BY l_suppkey ORDER BY t) - 1 AS k FROM sup, v),
  zs AS (SELECT * FROM (SELECT z, disc AS u, lead(z) OVER (PARTITION BY l_suppkey ORDER BY k) AS z1 FROM zz) WHERE z1 IS NOT NULL),
  ab AS (SELECT (sum(z1 * z) * sum(u * u) - sum(z1 * u) * sum(z * u)) / (sum(z * z) * sum(u * u) - sum(z * u) ** 2) AS a,
    (sum(z1 * u) * sum(z * z) - sum(z1 * z) * sum(z * u)) / (sum(z * z) * sum(u * u) - sum(z * u) ** 2) AS b FROM zs)"""
_kal1 = f"""{_mode}, top AS (SELECT max(k) AS top FROM zz),
  gp AS (SELECT 0::BIGINT AS k, v1 / (v1 * v1 + 1e-3) AS g, 1 - v1 * v1 / (v1 * v1 + 1e-3) AS p FROM v
    UNION ALL SELECT k + 1, m * v1 / (v1 * v1 * m + 1e-3), m - m * v1 * v1 * m / (v1 * v1 * m + 1e-3) FROM (SELECT k, a * a * p + 1e-6 AS m FROM gp, ab, top WHERE k < top), v),
  kf AS (SELECT l_suppkey, k, (qty - mq) / v1 AS x, 0.0::DOUBLE AS inn FROM zz, v WHERE k = 0
    UNION ALL SELECT n.l_suppkey, n.k, a * x + b * n.disc + g * (n.qty - mq - v1 * (a * x + b * n.disc)), n.qty - mq - v1 * (a * x + b * n.disc)
    FROM kf JOIN zz n ON n.l_suppkey = kf.l_suppkey AND n.k = kf.k + 1 JOIN gp ON gp.k = n.k, ab, v),
  es AS (SELECT l_suppkey, CAST(t AS BIGINT) AS t, mq + v1 * x AS est_qty, mr + v2 * x AS est_rev, x AS a1, p AS covariance_trace, inn AS innovation_qty FROM kf JOIN zz USING (l_suppkey, k) JOIN gp USING (k), v)"""


def _one_mode(df: DataFrame) -> fit.LinearModel:
    return fit.fit_pod_dmdc(fit.fit_transitions(df, SUP), fit.fit_snapshots(df, SUP.states), SUP, pod_rank=1)


@query("pod_one_mode_rollout", f"""WITH RECURSIVE {_mode}, ro AS (SELECT l_suppkey, k, z AS p, disc AS u FROM zz WHERE k = 0 UNION ALL SELECT n.l_suppkey, n.k, a * p + b * ro.u, n.disc FROM ro JOIN zz n ON n.l_suppkey = ro.l_suppkey AND n.k = ro.k + 1, ab)
  SELECT l_suppkey, t, round(mq + v1 * p, 4) AS pred_qty, round(mr + v2 * p, 4) AS pred_rev FROM ro JOIN zz USING (l_suppkey, k), v""")
def pod_one_mode_rollout(spark, d):
    df = supply(spark, d)
    return rounded(pred.rollout(df, SUP, _one_mode(df)), 4, "pred_qty", "pred_rev").select("l_suppkey", "t", "pred_qty", "pred_rev")


_ESTIMATES = ("est_qty", "est_rev", "a1", "innovation_qty")


@query("kalman_one_mode", f"WITH RECURSIVE {_kal1} SELECT l_suppkey, t, round(est_qty, 4) AS est_qty, round(est_rev, 4) AS est_rev, round(a1, 4) AS a1, round(covariance_trace, 9) AS covariance_trace, round(innovation_qty, 4) AS innovation_qty FROM es")
def kalman_one_mode(spark, d):
    df = supply(spark, d)
    out = pred.kalman_pod(df, SUP, _one_mode(df), ["qty"])
    return rounded(rounded(out, 4, *_ESTIMATES), 9, "covariance_trace").select("l_suppkey", F.col("t").cast("bigint").alias("t"), *_ESTIMATES, "covariance_trace")


@query("kalman_pod_estimates", None)
def kalman_pod_estimates(spark, d):
    df = supply(spark, d)
    model = fit.fit_pod_dmdc(fit.fit_transitions(df, SUP), fit.fit_snapshots(df, SUP.states), SUP, pod_rank=2)
    return pred.kalman_pod(df, SUP, model, ["qty"])


# -- forecasts, monitoring, bias --------------------------------------------------------------------------------

HORIZONS, STEP, TOL = (43200.0, 86400.0), 28800.0, 14400.0
_fc = f"""{st_sql}, cf AS {_ar}, fc AS (SELECT user_id, event_id AS origin_row_index, t AS origin_time, h AS forecast_horizon_s, n * 28800.0::DOUBLE AS effective_horizon_s,
  t + h AS target_time, pow(a, n) * x AS predicted_value FROM ev, cf, (VALUES (43200.0::DOUBLE, 2), (86400.0::DOUBLE, 3)) v(h, n))"""
_res = f"""{_fc}, mt AS (SELECT fc.*, e.t AS matched_time, e.x AS measured_value, row_number() OVER (PARTITION BY origin_row_index, forecast_horizon_s ORDER BY abs(e.t - target_time), e.t) AS rnk
  FROM fc JOIN ev e ON e.user_id = fc.user_id AND e.t BETWEEN target_time - 14401 AND target_time + 14401 AND abs(e.t - target_time) <= 14400),
  res AS (SELECT *, measured_value - predicted_value AS residual, abs(measured_value - predicted_value) AS abs_residual FROM mt WHERE rnk = 1)"""
_alerts = f"""{_res}, al AS (SELECT user_id, matched_time AS time, CASE WHEN abs_residual > 120 THEN 'critical' ELSE 'warning' END AS severity, 'FORECAST_RESIDUAL_HIGH' AS code, 'x' AS state,
  abs_residual AS value, 60.0::DOUBLE AS threshold FROM res WHERE abs_residual > 60
  UNION ALL SELECT user_id, t, 'warning', 'OPERATING_CONDITION_OUT_OF_RANGE', 'x', x, NULL FROM ev WHERE x < 1 OR x > 150)"""
_trust = f"""{_alerts}, tk AS (SELECT user_id, event_id, t FROM ev), tc AS (SELECT tk.user_id, tk.event_id, tk.t, count(*) FILTER (al.severity = 'warning') AS w, count(*) FILTER (al.severity = 'critical') AS c
  FROM tk LEFT JOIN al ON al.user_id = tk.user_id AND al.time <= tk.t GROUP BY ALL), tr AS (SELECT user_id, t AS time, greatest(0.0::DOUBLE, 1.0::DOUBLE - w * 0.02::DOUBLE - c * 0.05::DOUBLE) AS trust_score, w, c FROM tc)"""


def forecasts(spark, d):
    return pred.forecast(events(spark, d), ar(spark, d), "t", HORIZONS, dt=STEP, keys=["user_id"], row_index="event_id")


def residuals(spark, d, asked=None):
    return mon.forecast_residuals(events(spark, d), asked if asked is not None else forecasts(spark, d), ["user_id"], "t", ["x"], tolerance=TOL)


def alerts(spark, d, found=None):
    return mon.build_alerts(keys=["user_id"], residuals=found if found is not None else residuals(spark, d), clean=events(spark, d), time="t",
                            residual_threshold=60.0, operating_ranges={"x": (1.0, 150.0)})


def trust(spark, d, raised=None):
    return mon.trust_timeline(raised if raised is not None else alerts(spark, d), events(spark, d), ["user_id"], "t", warning_penalty=0.02, critical_penalty=0.05)


@query("forecast_horizons", f"""WITH {_fc} SELECT user_id, origin_row_index, forecast_horizon_s, effective_horizon_s, round(target_time, 3) AS target_time, round(predicted_value, 6) AS predicted_value FROM fc""")
def forecast_horizons(spark, d):
    out = forecasts(spark, d).select("user_id", "origin_row_index", "forecast_horizon_s", "effective_horizon_s", "target_time", "predicted_value")
    return rounded(rounded(out, 3, "target_time"), 6, "predicted_value")


@query("forecasts_wide", f"""WITH {_fc} SELECT user_id, origin_row_index, forecast_horizon_s, round(predicted_value, 6) AS x FROM fc""")
def forecasts_wide(spark, d):
    return rounded(S.forecasts_wide(forecasts(spark, d), ["user_id", "origin_row_index", "forecast_horizon_s"], ["x"]), 6, "x")


@query("forecast_residuals", f"""WITH {_res} SELECT user_id, origin_row_index, forecast_horizon_s, round(matched_time, 3) AS matched_time, round(abs(matched_time - target_time), 3) AS time_error_s,
  measured_value, round(predicted_value, 6) AS predicted_value, round(residual, 6) AS residual, round(abs_residual, 6) AS abs_residual FROM res""")
def forecast_residuals(spark, d):
    out = residuals(spark, d).select("user_id", "origin_row_index", "forecast_horizon_s", "matched_time", "time_error_s", "measured_value", "predicted_value", "residual", "abs_residual")
    return rounded(rounded(out, 3, "matched_time", "time_error_s"), 6, "predicted_value", "residual", "abs_residual")


@query("match_tolerance", f"WITH {dt_sql} SELECT user_id, round(0.55 * quantile_cont(dt, 0.5), 3) AS tolerance FROM d WHERE dt > 0 GROUP BY 1")
def match_tolerance(spark, d):
    return mon.match_tolerance(events(spark, d), ["user_id"], "t").select("user_id", r("_tolerance", 3).alias("tolerance"))


@query("alerts", f"WITH {_alerts} SELECT user_id, round(time, 3) AS time, severity, code, state, round(value, 6) AS value, threshold FROM al")
def alerts_query(spark, d):
    return rounded(rounded(alerts(spark, d).drop("message", "suggested_action"), 3, "time"), 6, "value")


@query("innovation_alerts", f"""WITH RECURSIVE {_kal} SELECT user_id, round(t, 3) AS time, CASE WHEN abs(inn) > 120 THEN 'critical' ELSE 'warning' END AS severity,
  'KALMAN_INNOVATION_HIGH' AS code, 'x' AS state, round(abs(inn), 6) AS value FROM kf JOIN rn USING (user_id, k) WHERE abs(inn) > 60
  UNION ALL SELECT user_id, round(t, 3), 'warning', 'KALMAN_INNOVATION_NORM_HIGH', NULL, round(abs(inn), 6) FROM kf JOIN rn USING (user_id, k) WHERE abs(inn) > 100
  UNION ALL SELECT user_id, round(t, 3), 'warning', 'STATE_ESTIMATE_UNCERTAINTY_HIGH', NULL, round(p, 6) FROM kf JOIN rn USING (user_id, k) WHERE p > 0.05
  UNION ALL SELECT user_id, round(t, 3), 'critical', 'STATE_ESTIMATE_MAGNITUDE_HIGH', 'est_x', round(abs(s), 6) FROM kf JOIN rn USING (user_id, k) WHERE abs(s) > 40""")
def innovation_alerts(spark, d):
    est = pred.kalman_filter(events(spark, d), EV_FREE, ar(spark, d), ["x"], np.eye(1), q=np.eye(1) * 0.01, r=np.eye(1) * 0.1)
    est = est.withColumn("origin_row_index", F.col("event_id"))
    inn = pred.innovations_long(est, ["user_id"], "t", ["x"])
    out = mon.build_alerts(keys=["user_id"], innovations=inn, estimates=est.withColumn("origin_time", F.col("t")), states=["est_x"], innovation_threshold=60.0,
                           innovation_norm_threshold=100.0, covariance_trace_threshold=0.05, max_abs_value=40.0)
    return rounded(rounded(out.select("user_id", "time", "severity", "code", "state", "value"), 3, "time"), 6, "value")


@query("trust_timeline", f"WITH {_trust} SELECT user_id, round(time, 3) AS time, round(trust_score, 6) AS trust_score, CAST(w AS INT) AS n_warning_alerts, CAST(c AS INT) AS n_critical_alerts FROM tr")
def trust_timeline(spark, d):
    return rounded(rounded(trust(spark, d), 3, "time"), 6, "trust_score")


@query("monitoring_summary", f"""WITH {_trust}, a AS (SELECT user_id, count(*) AS n_alerts, count(*) FILTER (severity = 'warning') AS n_warning_alerts, count(*) FILTER (severity = 'critical') AS n_critical_alerts FROM al GROUP BY 1),
  q AS (SELECT user_id, count(*) AS n_residual_rows, round(max(abs_residual), 6) AS max_abs_residual FROM res GROUP BY 1), f AS (SELECT user_id, round(arg_max(trust_score, time), 6) AS final_trust_score FROM tr GROUP BY 1)
  SELECT user_id, final_trust_score, coalesce(n_alerts, 0) AS n_alerts, coalesce(n_warning_alerts, 0) AS n_warning_alerts, coalesce(n_critical_alerts, 0) AS n_critical_alerts,
  coalesce(n_residual_rows, 0) AS n_residual_rows, max_abs_residual FROM f LEFT JOIN a USING (user_id) LEFT JOIN q USING (user_id)""")
def monitoring_summary(spark, d):
    found = residuals(spark, d)
    raised = alerts(spark, d, found)
    out = mon.summarize_monitoring(raised, found, trust(spark, d, raised), ["user_id"]).drop("mean_abs_residual")
    return rounded(out, 6, "final_trust_score", "max_abs_residual")


RULES = B.BiasRules(learning_rate=0.3, max_abs_bias=12.0, max_step=6.0, min_trust=0.9, clip_residual=40.0)
_bias = f"""{_trust}, tl AS (SELECT res.*, coalesce(tr.trust_score, (SELECT arg_min(trust_score, time) FROM tr t2 WHERE t2.user_id = res.user_id), 1.0) AS trust_score
  FROM res ASOF LEFT JOIN tr ON res.user_id = tr.user_id AND res.matched_time >= tr.time),
  dc AS (SELECT *, CASE WHEN trust_score < 0.9 THEN 'trust_score_below_threshold'
  WHEN EXISTS (SELECT 1 FROM al WHERE al.user_id = tl.user_id AND al.time = tl.matched_time AND al.code = 'OPERATING_CONDITION_OUT_OF_RANGE') THEN 'outside_training_or_operating_envelope'
  WHEN EXISTS (SELECT 1 FROM al WHERE al.user_id = tl.user_id AND al.time = tl.matched_time AND al.severity = 'critical') THEN 'blocked_by_alert_severity_critical' ELSE 'accepted' END AS reason FROM tl),
  od AS (SELECT *, row_number() OVER (PARTITION BY user_id, forecast_horizon_s ORDER BY matched_time, origin_time, origin_row_index) AS seq FROM dc),
  be AS (SELECT user_id, forecast_horizon_s, seq, 0.0::DOUBLE AS old_bias, CASE WHEN reason = 'accepted' THEN least(greatest(least(greatest(0.3 * least(greatest(residual, -40), 40), -6), 6), -12), 12) ELSE 0.0 END AS new_bias FROM od WHERE seq = 1
  UNION ALL SELECT o.user_id, o.forecast_horizon_s, o.seq, be.new_bias, CASE WHEN o.reason = 'accepted' THEN
  least(greatest(be.new_bias + least(greatest(0.3 * (least(greatest(o.residual, -40), 40) - be.new_bias), -6), 6), -12), 12) ELSE be.new_bias END
  FROM be JOIN od o ON o.user_id = be.user_id AND o.forecast_horizon_s = be.forecast_horizon_s AND o.seq = be.seq + 1),
  bv AS (SELECT od.*, be.old_bias, be.new_bias FROM od JOIN be USING (user_id, forecast_horizon_s, seq))"""
_corr = f"""{_bias}, ac AS (SELECT user_id, forecast_horizon_s, matched_time AS bt, arg_max(new_bias, seq) AS bias FROM bv WHERE reason = 'accepted' GROUP BY 1, 2, 3),
  co AS (SELECT fc.*, coalesce(ac.bias, 0.0) AS applied_bias, fc.predicted_value + coalesce(ac.bias, 0.0) AS corrected FROM fc ASOF LEFT JOIN ac ON fc.user_id = ac.user_id
  AND fc.forecast_horizon_s = ac.forecast_horizon_s AND fc.origin_time >= ac.bt)"""


def bias_chain(spark, d, found=None):
    """Each table of the chain is read several times below, so each is written once."""
    found = found if found is not None else kept(residuals(spark, d))
    raised = kept(alerts(spark, d, found))
    return kept(B.bias_events(found, raised, kept(trust(spark, d, raised)), ["user_id"], RULES))


@query("bias_events", f"""WITH RECURSIVE {_bias} SELECT user_id, origin_row_index, forecast_horizon_s, round(old_bias, 6) AS old_bias, round(new_bias, 6) AS new_bias, round(new_bias - old_bias, 6) AS delta_bias,
  CASE WHEN reason = 'accepted' THEN round(least(greatest(residual, -40), 40), 6) END AS residual_used, round(trust_score, 6) AS trust_score, reason = 'accepted' AS accepted, reason AS rejection_reason FROM bv""")
def bias_events(spark, d):
    out = bias_chain(spark, d).select("user_id", "origin_row_index", "forecast_horizon_s", "old_bias", "new_bias", "delta_bias", "residual_used", "trust_score", "accepted", "rejection_reason")
    return rounded(out, 6, "old_bias", "new_bias", "delta_bias", "residual_used", "trust_score")


@query("bias_corrected_forecasts", f"""WITH RECURSIVE {_corr} SELECT user_id, origin_row_index, forecast_horizon_s, round(applied_bias, 6) AS applied_bias, round(corrected, 6) AS bias_corrected_predicted_value,
  CASE WHEN forecast_horizon_s = 43200 THEN 'x@43200s' ELSE 'x@86400s' END AS bias_key FROM co""")
def bias_corrected_forecasts(spark, d):
    out = B.apply_bias(forecasts(spark, d), bias_chain(spark, d), ["user_id"])
    return rounded(out, 6, "applied_bias", "bias_corrected_predicted_value").select(
        "user_id", "origin_row_index", "forecast_horizon_s", "applied_bias", "bias_corrected_predicted_value", "bias_key")


@query("bias_summary_by_state", f"""WITH RECURSIVE {_bias}, h AS (SELECT user_id, forecast_horizon_s, count(*) AS n, count(*) FILTER (reason = 'accepted') AS ok, arg_max(new_bias, seq) FILTER (reason = 'accepted') AS last,
  max(abs(new_bias)) AS mx, sum(abs_residual) AS sa FROM bv GROUP BY 1, 2)
  SELECT user_id, 'x' AS state, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(ok) AS BIGINT) AS n_accepted, CAST(sum(n - ok) AS BIGINT) AS n_skipped, round(coalesce(avg(last), 0), 6) AS final_bias_mean, round(max(mx), 6) AS max_abs_bias,
  round(sum(sa) / sum(n), 6) AS mean_abs_raw_residual FROM h GROUP BY 1""")
def bias_summary_by_state(spark, d):
    return rounded(B.summarize_bias_by_state(bias_chain(spark, d), ["user_id"]), 6, "final_bias_mean", "max_abs_bias", "mean_abs_raw_residual")


@query("bias_summary_by_horizon", f"""WITH RECURSIVE {_bias} SELECT forecast_horizon_s, count(*) AS n_events, count(*) FILTER (reason = 'accepted') AS n_accepted, count(*) FILTER (reason <> 'accepted') AS n_skipped,
  round(avg(abs(new_bias)), 6) AS mean_abs_bias, round(avg(abs_residual), 6) AS mean_abs_raw_residual FROM bv GROUP BY 1""")
def bias_summary_by_horizon(spark, d):
    return rounded(B.summarize_bias_by_horizon(bias_chain(spark, d)), 6, "mean_abs_bias", "mean_abs_raw_residual")


@query("bias_timeseries", f"""WITH RECURSIVE {_bias} SELECT user_id, round(matched_time, 3) AS time, 'x' AS state, forecast_horizon_s, round(new_bias, 6) AS bias_value, reason = 'accepted' AS update_allowed, reason AS reason_if_skipped FROM bv""")
def bias_timeseries(spark, d):
    out = B.bias_state_timeseries(bias_chain(spark, d), ["user_id"]).drop("residual_used", "trust_score")
    return rounded(rounded(out, 3, "time"), 6, "bias_value")


@query("bias_error_comparison", f"""WITH RECURSIVE {_corr}, cr AS (SELECT res.forecast_horizon_s, abs_residual AS ra, abs(measured_value - corrected) AS ca FROM res JOIN co ON res.origin_row_index = co.origin_row_index AND res.forecast_horizon_s = co.forecast_horizon_s)
  SELECT 'x' AS state, forecast_horizon_s, round(avg(ra), 6) AS raw_mean_abs_residual, round(max(ra), 6) AS raw_max_abs_residual, count(*) AS n_raw, round(avg(ca), 6) AS corrected_mean_abs_residual, round(max(ca), 6) AS corrected_max_abs_residual,
  count(*) AS n_corrected, round(avg(ra) - avg(ca), 6) AS mean_abs_residual_improvement, round(max(ra) - max(ca), 6) AS max_abs_residual_improvement FROM cr GROUP BY 2""")
def bias_error_comparison(spark, d):
    asked = kept(forecasts(spark, d))
    found = kept(residuals(spark, d, asked))
    moved = kept(B.apply_bias(asked, bias_chain(spark, d, found), ["user_id"]))
    out = B.compare_errors(found, B.corrected_residuals(events(spark, d), moved, ["user_id"], "t", ["x"], TOL))
    return rounded(out, 6, *[c for c in out.columns if c not in ("state", "forecast_horizon_s", "n_raw", "n_corrected")])


# -- live log -------------------------------------------------------------------------------------------------

_arr = """arr AS (SELECT o_custkey AS cust, o_orderkey AS seq, epoch_us(o_orderdate)/1e6/86400.0 AS t, o_totalprice/1000.0 AS price FROM orders)"""
_checked = f"""{_arr}, ck AS (SELECT cust, seq, t, price, CASE WHEN t < lt THEN 'NONMONOTONIC_LIVE_TIME' WHEN t = lt OR dup > 1 THEN 'DUPLICATE_LIVE_TIME' END AS code
  FROM (SELECT *, lag(t) OVER (PARTITION BY cust ORDER BY seq) AS lt, row_number() OVER (PARTITION BY cust, t ORDER BY seq) AS dup FROM arr))"""


@query("live_row_checks", f"WITH {_checked} SELECT cust, seq AS _stream_row_index, code AS _code FROM ck")
def live_row_checks(spark, d):
    return BUF.check_table(arrivals(spark, d), ARR).select("cust", "_stream_row_index", "_code")


@query("live_row_checks_stream", f"WITH {_checked} SELECT cust, seq AS _stream_row_index, code AS _code FROM ck")
def live_row_checks_stream(spark, d):
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = arrivals(spark, d)
    rows.repartition(4).write.parquet(f"{root}/in")
    stream = IN.replay_stream(spark, f"{root}/in", rows.schema, files_per_trigger=100)
    checked = BUF.check_stream(stream, ARR, remember_seconds=1e9).select("cust", "_stream_row_index", "_code")
    q = checked.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("live_warnings", f"WITH {_checked} SELECT cust, code, seq AS sample_row_index FROM ck WHERE code IS NOT NULL")
def live_warnings(spark, d):
    return BUF.buffer_warnings(BUF.check_table(arrivals(spark, d), ARR), ["cust"]).drop("message", "suggested_action")


@query("rolling_buffer", f"""WITH {_arr} SELECT cust, seq AS _stream_row_index, price FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY seq DESC) AS b,
  last_value(t) OVER (PARTITION BY cust ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lt FROM arr) WHERE b <= 5 AND t >= lt - 600""")
def rolling_buffer(spark, d):
    return BUF.trim(arrivals(spark, d), ARR, max_samples=5, buffer_seconds=600.0).drop("t")


@query("latest_rows", f"WITH {_arr} SELECT cust, max(seq) AS _stream_row_index, arg_max(price, seq) AS price FROM arr GROUP BY 1")
def latest_rows(spark, d):
    return BUF.latest_rows(arrivals(spark, d), ARR).select("cust", "_stream_row_index", "price")


@query("buffer_summary", f"""WITH {_arr}, s AS (SELECT *, t - lag(t) OVER (PARTITION BY cust ORDER BY seq) AS dt FROM arr)
  SELECT cust, count(*) AS n_clean_samples, arg_min(t, seq) AS start_time, arg_max(t, seq) AS end_time, min(dt) AS min_dt, max(dt) AS max_dt, quantile_cont(dt, 0.5) AS median_dt FROM s GROUP BY 1""")
def buffer_summary(spark, d):
    return BUF.buffer_summary(arrivals(spark, d), ARR).drop("dt_ratio")


# -- archive and summaries ----------------------------------------------------------------------------------------

_win = "(VALUES ('3600s', 3600.0), ('86400s', 86400.0), ('604800s', 604800.0)) w(lab, sz)"
WIN = (3600.0, 86400.0, 604800.0)


@query("window_summary", f"""WITH {ev_sql}, z AS (SELECT lab AS "window", floor(t / sz) * sz AS window_start, s.state, s.v, t, event_id FROM ev, {_win}, LATERAL (VALUES ('x', x), ('u', u)) s(state, v))
  SELECT "window", window_start, state, count(v) AS n, 0.0::DOUBLE AS missing_fraction, round(avg(v), 6) AS mean, round(stddev_pop(v), 5) AS std, min(v) AS min, max(v) AS max, arg_max(v, (t, event_id)) AS last,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95 FROM z GROUP BY 1, 2, 3""")
def window_summary(spark, d):
    out = SU.summarize_wide(events(spark, d), "t", ["x", "u"], windows=WIN, seq=("event_id",))
    return rounded(rounded(out, 6, "mean", "median", "p05", "p95"), 5, "std")


@query("residual_summary", f"""WITH {_res}, z AS (SELECT lab AS "window", floor(matched_time / sz) * sz AS window_start, residual, abs_residual FROM res, {_win})
  SELECT "window", window_start, 'x' AS state, count(*) AS n, round(sqrt(avg(residual ** 2)), 6) AS rmse, round(avg(abs_residual), 6) AS mae, round(max(abs_residual), 6) AS max_abs, round(avg(residual), 6) AS bias_mean,
  round(quantile_cont(abs_residual, 0.95), 6) AS p95_abs FROM z GROUP BY 1, 2""")
def residual_summary(spark, d):
    return rounded(SU.summarize_residuals(residuals(spark, d), windows=WIN), 6, "rmse", "mae", "max_abs", "bias_mean", "p95_abs")


@query("trust_summary", f"""WITH {_trust}, z AS (SELECT lab AS "window", floor(time / sz) * sz AS window_start, trust_score FROM tr, {_win})
  SELECT "window", window_start, count(*) AS n, round(avg(trust_score), 6) AS mean, round(min(trust_score), 6) AS min, count(*) FILTER (trust_score < 0.5) AS time_below_0p5_samples, round(quantile_cont(trust_score, 0.05), 6) AS p05 FROM z GROUP BY 1, 2""")
def trust_summary(spark, d):
    return rounded(SU.summarize_trust(trust(spark, d), windows=WIN), 6, "mean", "min", "p05")


@query("bias_window_summary", f"""WITH RECURSIVE {_bias}, z AS (SELECT lab AS "window", floor(matched_time / sz) * sz AS window_start, new_bias AS v FROM bv, {_win})
  SELECT "window", window_start, 'x' AS state, count(*) AS n, round(avg(v), 6) AS mean_bias, round(max(abs(v)), 6) AS max_abs_bias FROM z GROUP BY 1, 2""")
def bias_window_summary(spark, d):
    return rounded(SU.summarize_bias(B.bias_state_timeseries(bias_chain(spark, d)), windows=WIN).drop("last_bias"), 6, "mean_bias", "max_abs_bias")


@query("alert_summary", f"WITH {_alerts} SELECT severity, code, count(*) AS alert_count FROM al GROUP BY 1, 2")
def alert_summary(spark, d):
    return SU.summarize_alerts(alerts(spark, d))


@query("archive_partitions", """SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n FROM events GROUP BY 1, 2""")
def archive_partitions(spark, d):
    e = table(spark, d, "events")
    date, hour = AR.partition_columns(e, "ts")
    return e.groupBy(date.alias("date"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def _archived(spark, d):
    """Archive the residuals and alerts with time in units of 24 s, so that an archive hour is a day."""
    root = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    found = settle(residuals(spark, d))
    raised = alerts(spark, d, found)
    AR.archive_run({"residuals": found.withColumn("matched_time", (F.col("matched_time") - 1704067200.0) / 24.0),
                    "alerts": raised.withColumn("time", (F.col("time") - 1704067200.0) / 24.0)}, root, "run-1")
    return root


@query("archive_manifest", f"""WITH {_alerts} SELECT 'residuals' AS data_kind, 'relative' AS date_partition, printf('%04d', CAST(floor((matched_time - 1704067200.0) / 24 / 3600) AS BIGINT)) AS hour_partition, count(*) AS n_rows FROM res GROUP BY 1, 2, 3
  UNION ALL SELECT 'alerts', 'relative', printf('%04d', CAST(floor((time - 1704067200.0) / 24 / 3600) AS BIGINT)), count(*) FROM al GROUP BY 1, 2, 3""")
def archive_manifest(spark, d):
    manifest = AR.read_manifest(spark, _archived(spark, d))
    return manifest.groupBy("data_kind", "date_partition", "hour_partition").agg(F.sum("n_rows").alias("n_rows"))


@query("archive_search", f"""WITH {_alerts} SELECT 'residuals' AS data_kind, origin_row_index, forecast_horizon_s, round(abs_residual, 6) AS abs_residual FROM res WHERE abs_residual >= 100""")
def archive_search(spark, d):
    rows = AR.search_archive(spark, _archived(spark, d), residual_above=100.0)
    return rounded(rows.select("data_kind", "origin_row_index", "forecast_horizon_s", "abs_residual"), 6, "abs_residual")


@query("archive_context", f"WITH {_alerts} SELECT 'residuals' AS data_kind, count(*) AS rows FROM res UNION ALL SELECT 'alerts', count(*) FROM al")
def archive_context(spark, d):
    return AR.context_summary(AR.read_manifest(spark, _archived(spark, d))).select("data_kind", "rows")


@query("archive_validation", """SELECT 'warning' AS level, 'kind_not_present' AS code, k AS detail FROM (VALUES ('cleaned_stream'), ('state_estimates'), ('forecasts'), ('bias_update_events'), ('trust_score')) v(k)""")
def archive_validation(spark, d):
    return AR.validate_archive(spark, _archived(spark, d))


@query("archive_faults", f"""WITH {_alerts} SELECT 'error' AS level, 'missing_file' AS code, count(DISTINCT floor((matched_time - 1704067200.0) / 24 / 3600))::BIGINT AS n FROM res WHERE matched_time >= 1704067200.0 + 24 * 3600 * 10
  UNION ALL SELECT 'warning', 'recommended_columns_missing', 1 UNION ALL SELECT 'warning', 'kind_not_present', 5""")
def archive_faults(spark, d):
    """Findings of an archive whose later residual hours are listed under other paths and whose alerts lack their code."""
    root = _archived(spark, d)
    manifest = AR.read_manifest(spark, root)
    late = (F.col("data_kind") == "residuals") & (F.col("hour_partition") >= "0010")
    one_file = manifest.where(~late).unionByName(manifest.where(late).groupBy(*[c for c in manifest.columns if c == "hour_partition"]).agg(
        *[F.first(c).alias(c) for c in manifest.columns if c != "hour_partition"]))
    damaged = one_file.withColumns({"path": F.when(late, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")),
                                    "columns": F.when(F.col("data_kind") == "alerts", F.regexp_replace("columns", '"code",', "")).otherwise(F.col("columns"))})
    return AR.validate_archive(spark, root, damaged).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


# -- status ---------------------------------------------------------------------------------------------------------

@query("run_status", f"""WITH {_trust} SELECT (SELECT count(*) FROM ev) AS n_clean_samples, (SELECT round(max(t), 3) FROM ev) AS latest_time, (SELECT count(*) FROM fc) AS n_forecast_rows, (SELECT count(*) FROM res) AS n_residual_rows,
  (SELECT count(*) FROM al) AS n_alerts, (SELECT count(*) FROM al WHERE severity = 'critical') AS n_critical_alerts, (SELECT round(min(trust_score), 6) FROM tr) AS min_trust_score,
  CASE WHEN (SELECT count(*) FROM al WHERE severity = 'critical') > 0 THEN 'critical' ELSE 'warning' END AS status""")
def run_status(spark, d):
    found = residuals(spark, d)
    raised = alerts(spark, d, found)
    row = ST.run_status(clean=events(spark, d), time="t", forecasts=forecasts(spark, d), residuals=found, alerts=raised, trust=trust(spark, d, raised))
    return rounded(rounded(row, 3, "latest_time"), 6, "min_trust_score").select(
        "n_clean_samples", "latest_time", "n_forecast_rows", "n_residual_rows", "n_alerts", "n_critical_alerts", "min_trust_score", "status")


@query("latest_residuals", f"""WITH {_res} SELECT user_id, 'x' AS state, round(arg_max(residual, (matched_time, origin_row_index, forecast_horizon_s)), 6) AS residual, round(max(matched_time), 3) AS latest_time,
  CASE WHEN abs(arg_max(residual, (matched_time, origin_row_index, forecast_horizon_s))) >= 50 THEN 'critical' WHEN abs(arg_max(residual, (matched_time, origin_row_index, forecast_horizon_s))) >= 20 THEN 'warning' ELSE 'nominal' END AS status FROM res GROUP BY 1""")
def latest_residuals(spark, d):
    out = ST.latest_residual_by_state(residuals(spark, d), ["user_id"], ("origin_row_index", "forecast_horizon_s"))
    out = out.withColumn("status", ST.residual_status(F.col("abs_residual"), 20.0, 50.0)).drop("abs_residual")
    return rounded(rounded(out, 3, "latest_time"), 6, "residual")


@query("top_residuals", f"WITH {_res} SELECT origin_row_index, forecast_horizon_s, round(abs_residual, 6) AS abs_residual FROM res ORDER BY res.abs_residual DESC, origin_row_index, forecast_horizon_s LIMIT 20")
def top_residuals(spark, d):
    out = ST.top_residuals(residuals(spark, d), 20, ("origin_row_index", "forecast_horizon_s"))
    return rounded(out.select("origin_row_index", "forecast_horizon_s", "abs_residual"), 6, "abs_residual")


@query("sensor_status", f"""WITH {_res}, b AS (SELECT concat('band', user_id % 4) AS state, residual, matched_time, origin_row_index, forecast_horizon_s FROM res), l AS (SELECT state, arg_max(residual, (matched_time, origin_row_index, forecast_horizon_s)) AS residual FROM b GROUP BY 1)
  SELECT s AS state, CAST(i AS DOUBLE) AS position_m, round(residual, 6) AS residual, CASE WHEN residual IS NULL THEN 'unknown' WHEN abs(residual) >= 50 THEN 'critical' WHEN abs(residual) >= 20 THEN 'warning' ELSE 'nominal' END AS status
  FROM (VALUES ('band0', 0), ('band1', 1), ('band2', 2), ('band3', 3), ('band9', 4)) v(s, i) LEFT JOIN l ON l.state = v.s""")
def sensor_status(spark, d):
    rows = residuals(spark, d).withColumn("state", F.concat(F.lit("band"), (F.col("user_id") % 4).cast("string")))
    out = ST.sensor_status(spark, ["band0", "band1", "band2", "band3", "band9"], rows, positions={f"band{i}": i for i in range(4)},
                           warning=20.0, critical=50.0, seq=("origin_row_index", "forecast_horizon_s"))
    return rounded(out.select("state", "position_m", "residual", "status"), 6, "residual")


@query("model_deployments", """SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderpriority AS stage, CAST(arg_max(o_orderkey, o_orderkey) AS VARCHAR) AS version FROM orders GROUP BY 1, 2""")
def model_deployments(spark, d):
    moves = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("stage"),
                                             F.col("o_orderkey").cast("string").alias("version"), F.format_string("%020d", "o_orderkey").alias("promoted_utc"))
    return MT.current_deployments(moves).select("name", "stage", "version")


@query("stream_estimates", None)
def stream_estimates(spark, d):
    """Filter the supply series as a stream (all rows in one available-now run)."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df = supply(spark, d)
    model = fit.fit_pod_dmdc(fit.fit_transitions(df, SUP), fit.fit_snapshots(df, SUP.states), SUP, pod_rank=2)
    rows = df.withColumn("_stream_row_index", F.col("t").cast("bigint"))
    rows.write.parquet(f"{root}/in")
    stream = IN.replay_stream(spark, f"{root}/in", rows.schema, files_per_trigger=1000)
    est = LIVE.estimate_stream(stream, SUP, model, ["qty"])
    q = est.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("_received_utc")


def _estimation_run(spark, d, chunks: int = 10) -> str:
    """The supply series as a live log in ten triggers, checked, filtered and archived by one streaming query."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df = supply(spark, d)
    model = _one_mode(df)
    IN.write_replay(df.drop("rev"), f"{root}/in", chunk_size=-(-df.count() // chunks), time="t", order=("l_suppkey",))
    schema = spark.read.parquet(f"{root}/in").schema
    LIVE.run_estimation(IN.replay_stream(spark, f"{root}/in", schema), SUP, f"{root}/archive", "run", f"{root}/ck", model, ["qty"],
                        horizons=(2592000.0,), dt=2592000.0, remember_seconds=1e9)
    return f"{root}/archive"


@query("live_estimation_run", f"""WITH RECURSIVE {_kal1} SELECT l_suppkey, t, round(est_qty, 4) AS est_qty, round(est_rev, 4) AS est_rev, round(a1, 4) AS a1, round(covariance_trace, 9) AS covariance_trace, round(innovation_qty, 4) AS innovation_qty FROM es""")
def live_estimation_run(spark, d):
    """State, modal, covariance and innovation tables of the run side by side."""
    root = _estimation_run(spark, d)
    by = ["l_suppkey", "t"]
    kind = lambda name, *columns: AR.load_kind(spark, root, name).select("l_suppkey", F.col("t").cast("bigint").alias("t"), *columns)
    inn = AR.load_kind(spark, root, "kalman_innovations").select("l_suppkey", F.col("origin_time").cast("bigint").alias("t"), F.col("innovation").alias("innovation_qty"))
    out = (kind("state_estimates", F.col("qty").alias("est_qty"), F.col("rev").alias("est_rev")).join(kind("modal_estimates", "a1"), by)
           .join(kind("estimate_covariance", "covariance_trace"), by).join(inn, by))
    return rounded(rounded(out, 4, *_ESTIMATES), 9, "covariance_trace").select(*by, *_ESTIMATES, "covariance_trace")


@query("live_archive_counts", f"""WITH {sup_sql}, n AS (SELECT count(*) AS n FROM sup) SELECT k AS data_kind, (n * m)::BIGINT AS n_rows FROM n,
  (VALUES ('raw_stream', 1), ('cleaned_stream', 1), ('state_estimates', 1), ('modal_estimates', 1), ('estimate_covariance', 1), ('kalman_innovations', 1), ('forecasts', 2)) v(k, m)""")
def live_archive_counts(spark, d):
    manifest = AR.read_manifest(spark, _estimation_run(spark, d, chunks=2))
    return manifest.groupBy("data_kind").agg(F.sum("n_rows").alias("n_rows"))


@query("followed_log", """SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def followed_log(spark, d):
    """The orders table written as text and followed as a growing log, in arrival order."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.round("o_totalprice", 2).cast("string").alias("o_totalprice"))
    TB.write_table(rows, f"{root}/log", "csv")
    stream = IN.make_stream(spark, "csv_tail", f"{root}/log", columns=["o_totalprice", "o_orderkey"])
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("o_orderkey").cast("bigint"), F.col("o_totalprice").cast("double"))


@query("live_checks_short_memory", f"""WITH {_arr}, ck AS (SELECT cust, seq, CASE WHEN t < lt THEN 'NONMONOTONIC_LIVE_TIME' WHEN t = lt OR (dup > 1 AND t >= peak - 200) THEN 'DUPLICATE_LIVE_TIME' END AS code
  FROM (SELECT *, lag(t) OVER (PARTITION BY cust ORDER BY seq) AS lt, row_number() OVER (PARTITION BY cust, t ORDER BY seq) AS dup,
    max(t) OVER (PARTITION BY cust ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM arr))
  SELECT cust, seq AS _stream_row_index, code AS _code FROM ck""")
def live_checks_short_memory(spark, d):
    """Time checks that forget times older than 200 days, as a stream of ten triggers."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = settle(arrivals(spark, d))
    IN.write_replay(rows.withColumnRenamed("_stream_row_index", "_n"), f"{root}/in", chunk_size=-(-rows.count() // 10), order=("_n",))
    stream = IN.replay_stream(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema)
    checked = BUF.check_stream(stream, ARR, remember_seconds=200.0).select("cust", F.col("_n").alias("_stream_row_index"), "_code")
    q = checked.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("archive_appends", """WITH o AS (SELECT CAST(floor(o_orderkey / 3600) AS BIGINT) AS h, o_orderkey % 3 AS part FROM orders) SELECT printf('%04d', h) AS hour_partition, count(*) AS n_rows, count(DISTINCT part) AS n_writes FROM o GROUP BY 1""")
def archive_appends(spark, d):
    """Three writes of one kind into the same hours of a run, one of them written twice."""
    root = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("double").alias("time"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 3).alias("part"))
    for part in (0, 1, 2, 1):
        AR.write_records(rows.where(F.col("part") == part), root, "raw_stream", "run", write_id=f"epoch-{part}")
    return AR.read_manifest(spark, root).groupBy("hour_partition").agg(F.sum("n_rows").alias("n_rows"), F.countDistinct("write_id").alias("n_writes"))


@query("archive_compacted", """SELECT CAST(floor(o_orderkey / 3600) AS BIGINT) AS hour, count(*) AS n, round(sum(o_totalprice), 2) AS price, 1 AS n_writes FROM orders GROUP BY 1""")
def archive_compacted(spark, d):
    """The rows of many writes after they were brought together into one."""
    root = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("double").alias("time"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 3).alias("part"))
    for part in (0, 1, 2):
        AR.write_records(rows.where(F.col("part") == part).drop("part"), root, "raw_stream", "run")
    AR.compact(spark, root, "raw_stream", "run")
    return AR.load_kind(spark, root, "raw_stream").groupBy(F.floor(F.col("time") / 3600).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("price"), 2).alias("price"), F.countDistinct("write_id").cast("int").alias("n_writes"))
