"""Model comparison on held-out cases, rank and delay sweeps, uncertainty and recommendation."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trajmill.operators import fitting as fit
from trajmill.operators.metrics import score_models, stability, summarise_scores, train_test_table
from trajmill.operators.prediction import rollout_many
from trajmill.operators.shaping import delay_embedding
from trajmill.operators.trees import TreeModel, rollout_trees
from trajmill.spec import TrajectorySpec


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def compare_models(df: DataFrame, spec: TrajectorySpec, names: list[str], *, rank=None, pod_rank=0.999,
                   alpha: float = 1e-4, trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """Fit every model on the train cases and roll all of them out over all cases.

    ``df`` carries a ``split`` column. One pass builds the factors all models share and one pass rolls
    the linear models and the baselines out side by side; each tree model has a pass of its own. Returns
    ``(table per model, errors per split/case/state)``.
    """
    train = _train(df)
    steps = fit.fit_transitions(train, spec)
    snapshots = fit.fit_snapshots(train, spec.states) if any(fit.MODEL_NAMES.get(n.lower(), "").startswith("pod") for n in names) else None
    models = {n: fit.fit_named(n, train, spec, steps=steps, snapshots=snapshots, rank=rank, pod_rank=pod_rank, alpha=alpha, trees=trees)
              for n in names}
    linear = {n: m if isinstance(m, fit.LinearModel) else _baseline(fit.MODEL_NAMES[n.lower()], m, spec)
              for n, m in models.items() if not isinstance(m, TreeModel)}
    keep = [*spec.keys, spec.time, *spec.order, *spec.states, "split"]
    by = ["split", *spec.keys]
    parts = []
    if linear:
        parts.append(score_models(rollout_many(df, spec, linear, keep=keep), spec, list(linear), by))
    for n, m in models.items():
        if isinstance(m, TreeModel):
            parts.append(score_models(rollout_trees(df, spec, m, keep=keep), spec, [""], by).withColumn("model_name", F.lit(n)))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    checks = pd.DataFrame([{"model_name": n, **(_judge(models[n]))} for n in names])
    table = train_test_table(scores).join(F.broadcast(df.sparkSession.createDataFrame(checks)), "model_name")
    return table.orderBy(F.col("test_rmse").asc_nulls_last(), "model_name"), scores


def _judge(model) -> dict:
    if isinstance(model, TreeModel):
        return {"spectral_radius": None, "n_unstable": 0, "stability_status": "not_applicable", "status": "ok"}
    if not isinstance(model, fit.LinearModel):
        return {"spectral_radius": None, "n_unstable": 0, "stability_status": "baseline", "status": "ok"}
    s = stability(model)
    return {"spectral_radius": s["spectral_radius"], "n_unstable": s["n_unstable"],
            "stability_status": s["status"], "status": "ok"}


def errors_by(scores: DataFrame, *by: str) -> DataFrame:
    """Errors by any of split, case, state and model from the shared sums."""
    return summarise_scores(scores, ["model_name", *by])


# -- sweeps ------------------------------------------------------------------------------------------------

def parse_rank(text) -> int | float | str | None:
    """Rank texts: "full", "auto", a share when it has a dot, else a count."""
    if text is None or isinstance(text, (int, float)):
        return text
    text = text.strip().lower()
    if text in ("full", "none", ""):
        return None
    return "auto" if text == "auto" else float(text) if "." in text else int(text)


def candidate_grid(models, pod_ranks, dmdc_ranks, delays) -> list[dict]:
    """All combinations, named in order."""
    out = []
    for i, (m, p, d, k) in enumerate(product(models, pod_ranks, dmdc_ranks, delays), start=1):
        name = f"run_{i:03d}__{m}__pod{'full' if p is None else p}__dmdc{'full' if d is None else d}__delay{k}"
        out.append({"run_name": name, "model": m, "pod_rank": p, "dmdc_rank": d, "n_delays": k})
    return out


def _baseline(kind: str, mean, spec: TrajectorySpec) -> fit.LinearModel:
    """Persistence and the training mean as linear models, so that they roll out in the same pass."""
    n, m = len(spec.states), len(spec.inputs)
    a = np.eye(n) if kind == "persistence" else np.zeros((n, n))
    offset = np.zeros(n) if kind == "persistence" else np.array([mean[c] for c in spec.states], float)
    return fit.LinearModel(kind, list(spec.states), list(spec.inputs), a, np.zeros((n, m)), offset)


def rank_delay_sweep(df: DataFrame, spec: TrajectorySpec, *, models=("dmdc",), pod_ranks=(0.999,), dmdc_ranks=(None,),
                     delays=(1,), alpha: float = 1e-4, trees: int = 100) -> DataFrame:
    """Score every candidate on train and test cases.

    Rows are read twice per *delay* (factors, rollouts), whatever the number of ranks and linear models; tree models have
    passes of their own. A
    candidate that cannot be fitted gives a row with status "failed". Errors cover all states of the
    embedding, delayed ones too; ``newest_*`` covers the undelayed states only.
    """
    grid, results = candidate_grid(models, pod_ranks, dmdc_ranks, delays), None
    spark = df.sparkSession
    for delay in dict.fromkeys(c["n_delays"] for c in grid):
        mine, notes, fitted = [c for c in grid if c["n_delays"] == delay], {}, {}
        if delay == 1:
            rows, view = df, spec
        else:
            shaped, view = delay_embedding(df, TrajectorySpec(
                time=spec.time, states=spec.states, inputs=spec.inputs, case=spec.case, order=(*spec.order, "split")), delay)
            rows, view = shaped, TrajectorySpec(time=spec.time, states=view.states, inputs=spec.inputs, case=spec.case, order=spec.order)
        train = _train(rows)
        steps = snapshots = None
        for c in mine:
            try:
                kind = fit.MODEL_NAMES.get(c["model"].lower(), c["model"])
                steps = steps or fit.fit_transitions(train, view)
                if kind.startswith("pod_"):
                    snapshots = snapshots or fit.fit_snapshots(train, view.states)
                model = fit.fit_named(c["model"], train, view, steps=steps, snapshots=snapshots, rank=c["dmdc_rank"],
                                      pod_rank=c["pod_rank"], alpha=alpha, trees=trees)
                if kind in ("persistence", "mean"):
                    model = _baseline(kind, model, view)
                fitted[c["run_name"]] = model
                notes[c["run_name"]] = {**_judge(model), "message": ""}
            except (ValueError, NotImplementedError, np.linalg.LinAlgError) as problem:
                notes[c["run_name"]] = {"spectral_radius": None, "n_unstable": None, "stability_status": None,
                                        "status": "failed", "message": str(problem)}
        described = spark.createDataFrame(
            [(c["run_name"], c["model"], str(c["pod_rank"]), str(c["dmdc_rank"]), int(delay), n["spectral_radius"],
              n["n_unstable"], n["stability_status"], n["status"], n["message"])
             for c in mine for n in [notes[c["run_name"]]]],
            "run_name string, model string, pod_rank string, dmdc_rank string, n_delays int, spectral_radius double, "
            "n_unstable int, stability_status string, status string, message string")
        if fitted:
            alias = {name: f"m{i}" for i, name in enumerate(fitted)}
            keep = [*view.keys, view.time, *view.order, *view.states, "split"]
            newest = {s for s in view.states if delay == 1 or s.endswith("__lag0")}
            side_by_side = {alias[n]: m for n, m in fitted.items() if not isinstance(m, TreeModel)}
            scores = [score_models(rollout_many(rows, view, side_by_side, keep=keep), view, list(side_by_side), ["split"])] if side_by_side else []
            scores += [score_models(rollout_trees(rows, view, m, keep=keep), view, [""], ["split"]).withColumn("model_name", F.lit(alias[n]))
                       for n, m in fitted.items() if isinstance(m, TreeModel)]
            scores = reduce(DataFrame.unionByName, scores)
            table = train_test_table(scores)
            table = table.join(train_test_table(scores.where(F.col("state").isin(newest))).select(
                "model_name", F.col("train_rmse").alias("newest_train_rmse"), F.col("test_rmse").alias("newest_test_rmse")), "model_name")
            back = F.create_map(*[F.lit(x) for n, a in alias.items() for x in (a, n)])
            table = table.withColumn("run_name", back[F.col("model_name")]).drop("model_name")
            scored = described.join(F.broadcast(table), "run_name", "left")
        else:
            scored = described.select("*", *[F.lit(None).cast("double").alias(c) for c in (
                "train_rmse", "test_rmse", "generalization_gap", "generalization_ratio")],
                F.lit(None).cast("boolean").alias("gap_warning"),
                *[F.lit(None).cast("double").alias(c) for c in ("newest_train_rmse", "newest_test_rmse")])
        results = scored if results is None else results.unionByName(scored)
    ok_first = F.when(F.col("status") == "ok", 0).otherwise(1)
    return results.orderBy(ok_first, F.col("test_rmse").asc_nulls_last(), "run_name")


def best_candidates(sweep: DataFrame, n: int = 10) -> DataFrame:
    return sweep.where(F.col("status") == "ok").orderBy(F.col("test_rmse").asc_nulls_last(), "run_name").limit(n)


def leave_one_out_scores(df: DataFrame, spec: TrajectorySpec, *, rank=None) -> DataFrame:
    """Train on all cases but one and give the one-step error on the case left out, for every case.

    Both sides come from factors: the fit from the merged factor of the others, the error from the
    factor of the held-out case. The rows are read once for all folds.
    """
    from trajmill.session import settle

    columns = fit.transition_columns(spec)
    own = settle(fit.case_factors(df, spec))
    held = fit.leave_one_out_factors(own, spec.case)
    both = own.select(F.col(spec.case).alias("case_key"), F.col("r").alias("own"), F.col("n_rows").alias("n_test"), "p").join(
        held.select(F.col(spec.case).alias("case_key"), F.col("r").alias("others"), F.col("n_rows").alias("n_train")), "case_key")
    kind = both.schema["case_key"].dataType.simpleString()

    def score(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if not row.n_train:
                    continue
                model = fit.fit_dmdc(fit.Factor(columns, np.asarray(row.others, float).reshape(-1, row.p), int(row.n_train)), spec, rank=rank)
                test = fit.Factor(columns, np.asarray(row.own, float).reshape(-1, row.p), int(row.n_test))
                left = test.of([f"next_{c}" for c in spec.states]) - test.of(spec.states) @ model.a.T - test.r[:, :1] * model.offset
                left = left - test.of(spec.inputs) @ model.b.T if spec.inputs else left
                out.append((row.case_key, int(row.n_train), model.metadata["one_step_rmse"],
                            float(np.linalg.norm(left) / np.sqrt(test.rows * len(spec.states)))))
            yield pd.DataFrame(out, columns=["case_key", "n_train", "train_rmse", "test_rmse"])

    return both.mapInPandas(score, f"case_key {kind}, n_train bigint, train_rmse double, test_rmse double").withColumnRenamed(
        "case_key", spec.case)


# -- uncertainty ---------------------------------------------------------------------------------------------

HELD_GROUPS = 1024  # groups whose sums a task keeps before it hands them on
_STEPS = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(18)])  # chances of at most k draws of a row


def _draws(place: np.ndarray, seed: int, n: int) -> np.ndarray:
    """How often each row (by its place) is drawn in each of ``n`` replicates: Poisson with mean 1, the same on every run."""
    with np.errstate(over="ignore"):
        x = place.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(n))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finisher of SplitMix64
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_STEPS, (x >> np.uint64(11)).astype(float) / 2.0**53).astype(float)


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, *, n: int = 500, confidence: float = 0.95, seed: int = 0,
                 root: bool = False) -> DataFrame:
    """Percentile interval of the mean of ``value`` per group by a Poisson bootstrap.

    Every row draws, for each replicate, how often it counts; a replicate's mean is the weighted mean. Draws depend on the seed and the
    row's place in the table, so a settled table gives the same interval again. Tasks add weighted sums of all replicates side by
    side while they read; rows are not shuffled, only groups x (replicates + 1) sums are, once. ``root`` gives the interval of the root mean.
    """
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    rows = usable.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.monotonically_increasing_id().alias("_place"),
                         F.col(value).cast("double").alias("_value"))
    names = [f"k{i}" for i in range(len(keys))]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in names)

    def add(frames):
        held: dict[tuple, np.ndarray] = {}

        def out():
            return pd.concat([pd.DataFrame({**dict(zip(names, key)), "_rep": np.arange(n + 1), "_weight": sums[0], "_sum": sums[1]}) if len(key) else
                              pd.DataFrame({"_rep": np.arange(n + 1), "_weight": sums[0], "_sum": sums[1]}) for key, sums in held.items()])

        for frame in frames:
            if not len(frame):
                continue
            codes = frame.groupby(names, dropna=False, sort=False).ngroup().to_numpy() if names else np.zeros(len(frame), int)
            order = np.argsort(codes, kind="stable")
            v = frame["_value"].to_numpy()[order]
            weights = np.column_stack([np.ones(len(v)), _draws(frame["_place"].to_numpy()[order], seed, n)])
            first = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            both = np.stack([np.add.reduceat(weights, first), np.add.reduceat(weights * v[:, None], first)], axis=1)
            for at, sums in zip(order[first], both):
                key = tuple(None if pd.isna(x) else x for x in (frame[k].iat[at] for k in names))
                held[key] = held[key] + sums if key in held else sums
            if len(held) > HELD_GROUPS:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = rows.mapInPandas(add, f"{kinds}_rep int, _weight double, _sum double")
    parts = parts.repartition(*names) if names else parts.repartition(1)  # n + 1 rows a task and group; both aggregations below use this
    means = parts.groupBy(*names, "_rep").agg(F.sum("_weight").alias("_weight"), F.sum("_sum").alias("_sum"))
    mean = F.when(F.col("_weight") > 0, F.col("_sum") / F.col("_weight"))
    tail = (1.0 - confidence) / 2.0
    share = F.when(F.col("_rep") > 0, F.sqrt(mean) if root else mean)
    whole = lambda c: F.max(F.when(F.col("_rep") == 0, c))
    spans = means.groupBy(*names).agg(
        whole(F.col("_weight")).cast("bigint").alias("n"), whole(F.sqrt(mean) if root else mean).alias("mean"),
        F.percentile(share, F.lit(tail)).alias("ci_low"), F.percentile(share, F.lit(1.0 - tail)).alias("ci_high"))
    return spans.select(*[F.col(a).alias(k) for a, k in zip(names, keys)], "n", "mean", "ci_low", "ci_high")


def bootstrap_metric(df: DataFrame, keys: list[str], true: str, predicted: str, metric: str = "rmse", **options) -> DataFrame:
    """Interval of an error of aligned true and predicted values by resampling rows: rmse, mse or mae."""
    gap = F.col(true).cast("double") - F.col(predicted).cast("double")
    if metric not in ("rmse", "mse", "mae"):
        raise ValueError(f"unknown metric: {metric!r}")
    error = F.abs(gap) if metric == "mae" else gap * gap
    return bootstrap_ci(df.withColumn("_error", error), keys, "_error", root=metric == "rmse", **options)


# -- recommendation --------------------------------------------------------------------------------------------

def recommend(table: DataFrame, error: str = "test_rmse", *, require_stable: bool = True,
              max_generalization_ratio: float | None = None, order: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """The usable model with the smallest error; when no row passes the filters all rows compete.

    One row: ``recommendation_status`` is ok, no_candidates, missing_error_column or no_finite_error.
    """
    spark = table.sparkSession
    if error not in table.columns:
        status = "no_candidates" if table.isEmpty() else "missing_error_column"
        return spark.createDataFrame([(status, False)], "recommendation_status string, used_fallback boolean")
    passes = F.lit(True)
    if "status" in table.columns:
        passes = passes & (F.coalesce(F.lower("status"), F.lit("ok")) == "ok")
    if require_stable and "stability_status" in table.columns:
        passes = passes & ~F.coalesce(F.lower("stability_status"), F.lit("")).contains("unstable")
    if max_generalization_ratio is not None and "generalization_ratio" in table.columns:
        passes = passes & F.coalesce(F.col("generalization_ratio") <= max_generalization_ratio, F.lit(False))
    value = F.col(error).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    counted = table.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(passes).alias("_passing"))
    judged = table.withColumns({"_pass": passes, "_finite": finite}).crossJoin(F.broadcast(counted))  # one row
    pool = judged.where(F.col("_finite") & (F.col("_pass") | (F.col("_passing") == 0)))
    best = pool.orderBy(value.asc(), *[c for c in order if c in table.columns]).limit(1)
    chosen = best.select(*table.columns, (F.col("_passing") == 0).alias("used_fallback"), F.lit(1).alias("_one"))
    return counted.withColumn("_one", F.lit(1)).join(chosen, "_one", "left").select(
        *table.columns, F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"),
        F.when(F.col("_rows") == 0, "no_candidates").when(F.col(error).isNull(), "no_finite_error").otherwise(
            "ok").alias("recommendation_status"))
