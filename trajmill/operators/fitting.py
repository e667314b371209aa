"""Linear fits from mergeable triangular factors.

Every linear model here is a function of the triangular factor ``R`` of tall matrices built from
``[1 | x | u | x_next]`` (transitions) and ``[1 | x]`` (snapshots). Partitions reduce their rows to
partial factors, factors merge in a tree of fixed fan-in, and only a factor of (number of
columns)**2 reaches the driver. Ranks, ridge strengths, masks, modal truncations and held-out
cases are solved from ``R`` without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from trajmill.functions import linalg as L
from trajmill.operators.quality import percentiles
from trajmill.operators.shaping import slopes, transitions
from trajmill.plans.segments import CaseLayout
from trajmill.spec import TrajectorySpec

FAN_IN = 64


# -- distributed factors --------------------------------------------------------------------------

FLUSH = 256  # factors per frame handed back to Spark


def _batch_factors(keys: list[str], columns: list[str], names: list[str]):
    """Fold Arrow batches into one factor per run of equal keys; memory is a few hundred factors per task."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, factor, rows, done = None, None, 0, []
        for frame in batches:
            if not len(frame):
                continue
            block = np.column_stack([np.ones(len(frame)), frame[columns].to_numpy(float)])
            change = np.zeros(len(frame), bool)
            for k in keys:
                codes, _ = pd.factorize(frame[k].to_numpy(), use_na_sentinel=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), len(frame)]
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(frame[k].iat[lo] for k in keys)
                if current is not None and key != current:
                    done.append((*current, rows, factor.ravel().tolist()))
                    factor, rows = None, 0
                current = key
                factor = L.stack_factor(factor, block[lo:hi])
                rows += hi - lo
            if len(done) >= FLUSH:
                yield pd.DataFrame(done, columns=names)
                done = []
        if current is not None:
            done.append((*current, rows, factor.ravel().tolist()))
        if done:
            yield pd.DataFrame(done, columns=names)

    return fold, len(columns) + 1


def _merge(frames: Iterator[pd.DataFrame], p: int, keys: list[str], names: list[str]) -> Iterator[pd.DataFrame]:
    """Stack factors of one task into one factor per run of keys (rows arrive sorted by key)."""
    current, factor, rows, done = None, None, 0, []
    for frame in frames:
        for *key, n, flat in frame[[*keys, "n_rows", "r"]].itertuples(index=False, name=None):
            key = tuple(key)
            if current is not None and key != current:
                done.append((*current, rows, factor.ravel().tolist()))
                factor, rows = None, 0
            current = key
            factor = L.stack_factor(factor, np.asarray(flat, float).reshape(-1, p))
            rows += n
        if len(done) >= FLUSH:
            yield pd.DataFrame(done, columns=names)
            done = []
    if current is not None:
        done.append((*current, rows, factor.ravel().tolist()))
    if done:
        yield pd.DataFrame(done, columns=names)


MERGE_LEVELS = 2  # before the last merge


def merge_tree_level(rows: DataFrame, number) -> DataFrame:
    """Number the group of FAN_IN neighbours that each partial factor merges into next."""
    return rows.withColumn("_g", F.floor(number / FAN_IN).cast("int"))


def factors(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Triangular factor of ``[1 | columns]`` per group: ``by..., n_rows, p, r`` (row-major).

    Rows are never shuffled for this; only partial factors are. A group leaves one partial factor per
    task that saw it. These merge in a tree by the number of their task: a group's factors of FAN_IN tasks, then of
    FAN_IN**2, then what is left, which is FAN_IN or fewer up to FAN_IN**3 (262,144) tasks.
    """
    by = list(by or [])
    source = {f.name: f for f in df.schema.fields}
    key_fields = [T.StructField(f"k{i}", source[k].dataType) for i, k in enumerate(by)]
    fields = T.StructType([*key_fields, T.StructField("n_rows", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType()))])
    keys = [f.name for f in key_fields]
    slim = df.select(*[F.col(k).alias(a) for k, a in zip(by, keys)],
                     *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    fold, p = _batch_factors(keys, [f"c{i}" for i in range(len(columns))], [f.name for f in fields])
    partial = slim.mapInPandas(fold, fields)

    def merged(rows: DataFrame, level: list[str]) -> DataFrame:
        kept = T.StructType([*key_fields, *[T.StructField(c, T.IntegerType()) for c in level], *fields.fields[len(keys):]])
        names = [*keys, *level]
        rows = rows.select(*names, "n_rows", "r")
        rows = rows.repartition(*names).sortWithinPartitions(*names) if names else rows.repartition(1)
        return rows.mapInPandas(lambda frames: _merge(frames, p, names, [f.name for f in kept]), kept)

    tree = merge_tree_level(partial, F.spark_partition_id())
    for _ in range(MERGE_LEVELS - 1):
        tree = merge_tree_level(merged(tree, ["_g"]), F.col("_g"))
    tree = merged(merged(tree, ["_g"]), [])
    return tree.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "n_rows", F.lit(p).alias("p"), "r")


@dataclass
class Factor:
    """A merged factor on the driver: ``r`` of ``[1 | columns]`` over ``rows`` rows."""

    columns: list[str]
    r: np.ndarray
    rows: int

    def at(self, names) -> list[int]:
        where = {c: i + 1 for i, c in enumerate(self.columns)}
        return [where[c] for c in names]

    def means(self, names) -> np.ndarray:
        # the first row of R is (sqrt(m), sqrt(m) * means) up to sign
        r = self.square()
        return r[0, self.at(names)] / r[0, 0]

    def stds(self, names) -> np.ndarray:
        r = self.square()
        return np.linalg.norm(r[1:, self.at(names)], axis=0) / np.sqrt(self.rows)

    def square(self) -> np.ndarray:
        return np.linalg.qr(self.r, mode="r")

    def of(self, names) -> np.ndarray:
        return self.r[:, self.at(names)]

    def mapped(self, weights: np.ndarray) -> np.ndarray:
        """Rows of R after a linear map of ``[1 | columns]``."""
        return self.r @ weights

    def merged(self, other: "Factor | None") -> "Factor":
        return self if other is None else Factor(self.columns, L.stack_factor(self.r, other.r), self.rows + other.rows)


def collect_factor(df: DataFrame, columns: list[str]) -> Factor:
    """Reduce to one factor; the driver receives one row."""
    total, rows = None, 0
    for row in factors(df, columns).collect():
        total = L.stack_factor(total, np.asarray(row["r"]).reshape(-1, row["p"]))
        rows += row["n_rows"]
    if total is None:
        raise ValueError("no rows to fit")
    return Factor(list(columns), total, rows)


def transition_columns(spec: TrajectorySpec) -> list[str]:
    return [*spec.values, *[f"next_{c}" for c in spec.states]]


# -- models -----------------------------------------------------------------------------------------

@dataclass
class LinearModel:
    """``x_next = A x + B u + offset`` in the units of the data (or the continuous-time pair).

    ``kind``: dmdc, ridge_dmdc, graph_dmdc, adaptive_dmdc (A, B are continuous), pod_dmdc, pod_ml.
    """

    kind: str
    states: list[str]
    inputs: list[str]
    a: np.ndarray
    b: np.ndarray
    offset: np.ndarray
    dt: float | None = None
    metadata: dict = field(default_factory=dict)
    pod: "PODBasis | None" = None

    @property
    def continuous(self) -> bool:
        return self.kind == "adaptive_dmdc"

    def step(self, dt: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Discrete (A, B); a continuous model needs the length of the step."""
        return L.hold_step(self.a, self.b, dt if dt is not None else self.dt) if self.continuous else (self.a, self.b)

    def physical(self) -> "LinearModel":
        """One-step map between full states: project, step, reconstruct."""
        if self.pod is None:
            return self
        enc, enc0, dec, dec0 = self.pod.encoder(), self.pod.encode_offset(), self.pod.decoder(), self.pod.mean
        a = dec @ self.a @ enc
        offset = dec @ (self.a @ enc0 + self.offset) + dec0
        return LinearModel(self.kind, self.pod.states, self.inputs, a, dec @ self.b, offset, self.dt, self.metadata)


def fit_dmdc(factor: Factor, spec: TrajectorySpec, *, rank=None, rcond: float | None = 1e-12, alpha: float = 0.0,
             center: bool = False, scale: bool = False, kind: str | None = None) -> LinearModel:
    """DMD with control; DMD without inputs; ridge with ``alpha`` (then without the rcond cut).

    Centre and scale come from the start states and inputs and are applied to the next states too.
    """
    n, m = len(spec.states), len(spec.inputs)
    omega_names, next_names = spec.values, [f"next_{c}" for c in spec.states]
    mean = factor.means(omega_names) if center else np.zeros(n + m)
    spread = factor.stds(omega_names) if scale else np.ones(n + m)
    spread = np.where(spread > 0, spread, 1.0)
    ones = factor.r[:, :1]
    omega = (factor.of(omega_names) - ones * mean) / spread
    target = (factor.of(next_names) - ones * mean[:n]) / spread[:n]
    ridge = kind == "ridge_dmdc"
    g, s, r = L.spectral_solve(omega, target, rank, None if ridge else rcond, alpha, factor.rows)
    error = np.linalg.norm((target - omega @ g.T) * spread[:n]) / np.sqrt(factor.rows * n)
    a_s, b_s = g[:, :n], g[:, n:]
    a = spread[:n, None] * a_s / spread[None, :n]
    b = spread[:n, None] * b_s / spread[None, n:]
    offset = mean[:n] - a @ mean[:n] - (b @ mean[n:] if m else 0.0)
    metadata = {"rank_used": r, "singular_values": s.tolist(), "n_transitions": factor.rows,
                "condition_number": float(s[0] / s[-1]) if s[-1] > 0 else float("inf"), "one_step_rmse": float(error),
                "alpha": alpha, "center": center, "scale": scale}
    return LinearModel(kind or "dmdc", list(spec.states), list(spec.inputs), a, b, offset, metadata=metadata)


def fit_ridge(factor: Factor, spec: TrajectorySpec, *, rank=None, alpha: float = 1e-6) -> LinearModel:
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return fit_dmdc(factor, spec, rank=rank, alpha=alpha, kind="ridge_dmdc")


def fit_transitions(df: DataFrame, spec: TrajectorySpec, layout: CaseLayout | None = None) -> Factor:
    """The factor all discrete fits share: one pass over the table."""
    return collect_factor(transitions(df, spec, layout), transition_columns(spec))


def fit_adaptive(df: DataFrame, spec: TrajectorySpec, *, rank=None, alpha: float = 1e-8,
                 rcond: float = 1e-12, layout: CaseLayout | None = None) -> LinearModel:
    """Continuous-time fit of slopes on states and inputs for tables with a varying step."""
    steps = slopes(df, spec, layout)
    slope_names = [f"slope_{c}" for c in spec.states]
    factor = collect_factor(steps, [*spec.values, *slope_names])
    g, s, r = L.spectral_solve(factor.of(spec.values), factor.of(slope_names), rank, rcond, alpha, factor.rows)
    n = len(spec.states)
    low, median, high = percentiles(steps.select("dt"), [], "dt", {"low": 0.0, "median": 0.5, "high": 1.0}).first()
    metadata = {"rank_used": r, "singular_values": s.tolist(), "n_transitions": factor.rows, "alpha": alpha,
                "median_dt": median, "min_dt": low, "max_dt": high,
                "condition_number": float(s[0] / s[-1]) if s[-1] > 0 else float("inf")}
    return LinearModel("adaptive_dmdc", list(spec.states), list(spec.inputs), g[:, :n], g[:, n:], np.zeros(n),
                       dt=median, metadata=metadata)


def ring_edges(nodes: list[str], self_edges: bool = True, directed: bool = False) -> list[tuple[str, str]]:
    """Edges of a closed loop."""
    edges = [(a, a) for a in nodes] if self_edges else []
    for a, b in zip(nodes, [*nodes[1:], nodes[0]]):
        edges += [(a, b)] if directed else [(a, b), (b, a)]
    return list(dict.fromkeys(edges))


def allowed_mask(nodes: list[str], edges) -> np.ndarray:
    """mask[target, source] of the allowed influences."""
    at = {c: i for i, c in enumerate(nodes)}
    unknown = {c for e in edges for c in e} - at.keys()
    if unknown:
        raise ValueError(f"edges name unknown nodes: {sorted(unknown)}")
    mask = np.zeros((len(nodes), len(nodes)), bool)
    for source, target in edges:
        mask[at[target], at[source]] = True
    return mask


def fit_graph(factor: Factor, spec: TrajectorySpec, edges) -> LinearModel:
    """Each state depends on its graph predecessors and all inputs only; other entries are exactly 0."""
    mask = allowed_mask(list(spec.states), edges)
    if not mask.any(axis=1).all():
        raise ValueError("every state needs at least one predecessor")
    n, m = len(spec.states), len(spec.inputs)
    a, b, residuals = np.zeros((n, n)), np.zeros((n, m)), []
    for i, state in enumerate(spec.states):
        chosen = [c for c, ok in zip(spec.states, mask[i]) if ok]
        omega, target = factor.of([*chosen, *spec.inputs]), factor.of([f"next_{state}"])[:, 0]
        weights = np.linalg.lstsq(omega, target, rcond=None)[0]
        a[i, mask[i]], b[i] = weights[: len(chosen)], weights[len(chosen):]
        residuals.append(float(np.linalg.norm(target - omega @ weights)))
    return LinearModel("graph_dmdc", list(spec.states), list(spec.inputs), a, b, np.zeros(n),
                       metadata={"row_residual_norms": residuals, "n_transitions": factor.rows})


# -- modal bases --------------------------------------------------------------------------------------

@dataclass
class PODBasis:
    """Orthogonal modes of centred (and scaled) snapshots; mode signs are fixed by their peak entry."""

    states: list[str]
    mean: np.ndarray
    spread: np.ndarray
    modes: np.ndarray
    singular_values: np.ndarray
    rows: int
    all_modes: np.ndarray

    @property
    def rank(self) -> int:
        return self.modes.shape[1]

    def encoder(self) -> np.ndarray:
        return self.modes.T / self.spread

    def encode_offset(self) -> np.ndarray:
        return -self.encoder() @ self.mean

    def decoder(self) -> np.ndarray:
        return self.spread[:, None] * self.modes

    def energies(self) -> pd.DataFrame:
        s2 = self.singular_values**2
        share = s2 / s2.sum() if s2.sum() > 0 else np.zeros_like(s2)
        return pd.DataFrame({"mode": np.arange(1, len(s2) + 1), "singular_value": self.singular_values,
                             "explained_energy": share, "cumulative_energy": L.energy_curve(self.singular_values)})

    def truncated(self, rank: int) -> "PODBasis":
        return PODBasis(self.states, self.mean, self.spread, self.all_modes[:, :rank], self.singular_values,
                        self.rows, self.all_modes)


def fit_pod(factor: Factor, states, *, rank=None, energy_threshold: float | None = None, center: bool = True,
            scale: bool = False) -> PODBasis:
    """Modes of the snapshots from the factor of ``[1 | x]``."""
    states = list(states)
    mean = factor.means(states) if center else np.zeros(len(states))
    spread = factor.stds(states) if scale else np.ones(len(states))
    spread = np.where(spread > 0, spread, 1.0)
    processed = (factor.of(states) - factor.r[:, :1] * mean) / spread
    _, s, wt = np.linalg.svd(processed, full_matrices=False)
    s, wt = s[: min(len(s), factor.rows)], wt[: min(len(s), factor.rows)]
    r = L.pick_rank(s, rank if energy_threshold is None else float(energy_threshold), factor.rows)
    modes = L.fixed_signs(wt.T)
    return PODBasis(states, mean, spread, modes[:, :r], s, factor.rows, modes)


def fit_snapshots(df: DataFrame, states) -> Factor:
    return collect_factor(df, list(states))


def reconstruction_curve(factor: Factor, pod: PODBasis) -> pd.DataFrame:
    """Error of every truncation from the one factor: rank, rmse, relative error, cumulative energy."""
    centred = factor.of(pod.states) - factor.r[:, :1] * pod.mean
    whole = np.linalg.norm(factor.of(pod.states))
    energy, rows = L.energy_curve(pod.singular_values), []
    for r in range(1, len(pod.singular_values) + 1):
        phi = pod.all_modes[:, :r]
        left = centred - ((centred / pod.spread) @ phi @ phi.T) * pod.spread
        norm = np.linalg.norm(left)
        rows.append((r, norm / np.sqrt(factor.rows * len(pod.states)), norm / whole if whole > 0 else norm, energy[r - 1]))
    return pd.DataFrame(rows, columns=["rank", "rmse", "relative_error", "cumulative_energy"])


def _modal_map(factor: Factor, spec: TrajectorySpec, pod: PODBasis) -> tuple[np.ndarray, np.ndarray]:
    """Factor rows of (modal state, input) and next modal state: a linear map, no further pass."""
    enc, at_zero = pod.encoder(), pod.encode_offset()
    ones = factor.r[:, :1]
    now = factor.of(spec.states) @ enc.T + ones * at_zero
    nxt = factor.of([f"next_{c}" for c in spec.states]) @ enc.T + ones * at_zero
    omega = np.column_stack([now, factor.of(spec.inputs)]) if spec.inputs else now
    return omega, nxt


def fit_pod_dmdc(steps: Factor, snapshots: Factor, spec: TrajectorySpec, *, pod_rank=0.999, dmdc_rank=None,
                 rcond: float = 1e-12, center: bool = True, scale: bool = False, n_delays: int = 1,
                 pod: PODBasis | None = None) -> LinearModel:
    """Reduced-order DMDc: modes of all snapshots, then a fit between modal coefficients."""
    if n_delays != 1:
        raise NotImplementedError("the reduced-order fit takes no delays")
    pod = pod or fit_pod(snapshots, spec.states, rank=pod_rank, center=center, scale=scale)
    omega, nxt = _modal_map(steps, spec, pod)
    g, s, r = L.spectral_solve(omega, nxt, dmdc_rank, rcond, 0.0, steps.rows)
    k = pod.rank
    names = [f"a{i + 1}" for i in range(k)]
    return LinearModel("pod_dmdc", names, list(spec.inputs), g[:, :k], g[:, k:], np.zeros(k), pod=pod,
                       metadata={"rank_used": r, "pod_rank": k, "n_transitions": steps.rows, "singular_values": s.tolist()})


def fit_pod_ridge(steps: Factor, snapshots: Factor, spec: TrajectorySpec, *, pod_rank=0.999, alpha: float = 1.0,
                  center: bool = True, scale: bool = False, pod: PODBasis | None = None) -> LinearModel:
    """Ridge between modal coefficients with an intercept that is not penalised."""
    pod = pod or fit_pod(snapshots, spec.states, rank=pod_rank, center=center, scale=scale)
    omega, nxt = _modal_map(steps, spec, pod)
    ones = steps.r[:, :1]
    weight = (ones.T @ ones).item()  # rows of the table behind the factor
    mean_o, mean_t = (ones.T @ omega)[0] / weight, (ones.T @ nxt)[0] / weight
    g, s, r = L.spectral_solve(omega - ones * mean_o, nxt - ones * mean_t, None, None, alpha, steps.rows)
    k = pod.rank
    names = [f"a{i + 1}" for i in range(k)]
    return LinearModel("pod_ml", names, list(spec.inputs), g[:, :k], g[:, k:], mean_t - g @ mean_o, pod=pod,
                       metadata={"rank_used": r, "pod_rank": k, "alpha": alpha, "n_transitions": steps.rows})


# -- one model per case ---------------------------------------------------------------------------------

CASE_MODEL = ("n_transitions bigint, a array<array<double>>, b array<array<double>>, spectral_radius double, "
              "one_step_rmse double, a_c array<array<double>>, growth_rate double, frequency double")


def case_factors(df: DataFrame, spec: TrajectorySpec, layout: CaseLayout | None = None) -> DataFrame:
    """Table of one transition factor per case: the state that leave-one-out and sweeps merge."""
    return factors(transitions(df, spec, layout), transition_columns(spec), spec.keys)


def models_per_case(case_factor_table: DataFrame, spec: TrajectorySpec, *, rank=None, rcond: float = 1e-12,
                    alpha: float = 0.0, dt: DataFrame | float | None = None) -> DataFrame:
    """Solve every case's own model from its factor; with ``dt`` also continuous-time rates.

    ``dt`` is a number or a table ``(case, median_dt)``.
    """
    key_type = case_factor_table.schema[spec.case].dataType.simpleString()
    table = case_factor_table
    if isinstance(dt, DataFrame):
        table = table.join(dt.select(F.col(dt.columns[0]).alias(spec.case), F.col("median_dt").alias("_dt")), spec.case, "left")
    else:
        table = table.withColumn("_dt", F.lit(dt).cast("double"))
    columns = transition_columns(spec)

    def solve(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                factor = Factor(columns, np.asarray(row.r, float).reshape(-1, row.p), int(row.n_rows))
                model = fit_dmdc(factor, spec, rank=rank, rcond=rcond, alpha=alpha, kind="ridge_dmdc" if alpha > 0 else None)
                radius = float(np.abs(np.linalg.eigvals(model.a)).max())
                a_c = growth = frequency = None
                if row.step_dt and row.step_dt > 0:
                    rates, _ = L.to_continuous(model.a, model.b, row.step_dt)
                    if np.isfinite(rates).all():
                        values = np.linalg.eigvals(rates)
                        a_c, growth, frequency = rates.tolist(), float(values.real.max()), float(np.abs(values.imag).max())
                out.append((row.case_key, int(row.n_rows), model.a.tolist(), model.b.tolist(), radius,
                            model.metadata["one_step_rmse"], a_c, growth, frequency))
            yield pd.DataFrame(out, columns=["case_key", "n_transitions", "a", "b", "spectral_radius", "one_step_rmse",
                                             "a_c", "growth_rate", "frequency"])

    slim = table.select(F.col(spec.case).alias("case_key"), "n_rows", "p", "r", F.col("_dt").alias("step_dt"))
    return slim.mapInPandas(solve, f"case_key {key_type}, {CASE_MODEL}").withColumnRenamed("case_key", spec.case)


# -- leave one case out -------------------------------------------------------------------------------------

def leave_one_out_factors(case_factor_table: DataFrame, case: str, fan_in: int | None = None) -> DataFrame:
    """For every case the merged factor of all *other* cases, without subtracting anything.

    The table is read several times, so pass a settled one (``session.settle``). Cases are numbered and merged upward in a tree of
    ``fan_in``; then each node hands its "all others" factor down to its children, who add their siblings to it. Every
    group holds at most ``fan_in`` factors and one from above, whatever the number of cases, and the work is linear in it.
    """
    from trajmill.session import settle

    fan = fan_in or FAN_IN
    n, p = case_factor_table.agg(F.count(F.lit(1)), F.max("p")).first()
    case_type = case_factor_table.schema[case].dataType.simpleString()
    if not n:
        return case_factor_table.select(case, "n_rows", "p", "r")
    place = case_factor_table.select(F.col(case).alias("_case"), "n_rows", "r", F.spark_partition_id().alias("_task"),
                                     F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    tasks = place.groupBy("_task").agg(F.max("_at").alias("_top"))
    begin = tasks.select("_task", F.coalesce(F.sum(F.col("_top") + 1).over(
        Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    leaves = place.join(F.broadcast(begin), "_task").select("_case", (F.col("_begin") + F.col("_at")).alias("node"), "n_rows", "r")
    leaves = settle(leaves)
    nodes = "node bigint, n_rows bigint, r array<double>"

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        factor, rows = None, 0
        for r, k in zip(frame["r"], frame["n_rows"]):
            factor, rows = L.stack_factor(factor, np.asarray(r, float).reshape(-1, p)), rows + int(k)
        return pd.DataFrame({"node": [int(frame["node"].iat[0]) // fan], "n_rows": [rows], "r": [factor.ravel().tolist()]})

    levels, count = [leaves.select("node", "n_rows", "r")], n
    while count > fan:
        levels.append(settle(levels[-1].groupBy(F.floor(F.col("node") / fan)).applyInPandas(merge, nodes)))
        count = -(-count // fan)

    def hold_out(frame: pd.DataFrame) -> pd.DataFrame:
        above = frame[frame["_above"]]
        below = frame[~frame["_above"]].sort_values("node")
        base = (None, 0)
        if len(above) and len(above["r"].iat[0]):
            base = np.asarray(above["r"].iat[0], float).reshape(-1, p), int(above["n_rows"].iat[0])
        own = [(np.asarray(r, float).reshape(-1, p), int(k)) for r, k in zip(below["r"], below["n_rows"])]
        held = _all_but_one(own, base)
        return pd.DataFrame({"node": below["node"], "n_rows": [k for _, k in held], "r": [[] if f is None else f.ravel().tolist() for f, _ in held]})

    others = None
    for level in reversed(levels):
        group = F.floor(F.col("node") / fan) if others is not None else F.lit(0)
        rows = level.withColumns({"_above": F.lit(False), "_g": group})
        if others is not None:
            rows = rows.unionByName(others.withColumns({"_above": F.lit(True), "_g": F.col("node")}))
        others = rows.groupBy("_g").applyInPandas(hold_out, nodes)
    out = leaves.select("_case", "node").join(others, "node").select(F.col("_case").cast(case_type).alias(case), "n_rows", F.lit(p).cast("int").alias("p"), "r")
    return out


def _all_but_one(parts, base=(None, 0)):
    """Merged factor of all parts but each one, by prefix and suffix merges."""
    def fold(acc, part):
        if part[0] is None:
            return acc
        return (L.stack_factor(acc[0], part[0]), acc[1] + part[1])

    suffix = [base]
    for part in reversed(parts):
        suffix.append(fold(suffix[-1], part))
    suffix.reverse()
    prefix, out = (None, 0), []
    for i, part in enumerate(parts):
        out.append(fold(suffix[i + 1], prefix))
        prefix = fold(prefix, part)
    return out


# -- baselines and modal features ----------------------------------------------------------------------------

def fit_mean(df: DataFrame, states) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in states]).first()
    return {c: row[c] for c in states}


def modal_features(steps: DataFrame, spec: TrajectorySpec, pod: PODBasis) -> DataFrame:
    """Modal coefficients of the start and (where present) next states as column expressions."""
    from trajmill.operators.prediction import encode_columns

    columns = {f"a{i + 1}": c for i, c in enumerate(encode_columns(pod, pod.states))}
    nxt = [f"next_{c}" for c in pod.states]
    if all(c in steps.columns for c in nxt):
        columns.update({f"next_a{i + 1}": c for i, c in enumerate(encode_columns(pod, nxt))})
    return steps.withColumns(columns)


# Accepted model names.
MODEL_NAMES = {
    "persistence": "persistence", "mean": "mean",
    "dmd": "dmdc", "dmdc": "dmdc",
    "ridge_dmdc": "ridge_dmdc", "regularized_dmdc": "ridge_dmdc", "ridge_dmd": "ridge_dmdc",
    "adaptive_dmdc": "adaptive_dmdc", "variable_dt_dmdc": "adaptive_dmdc", "adaptive": "adaptive_dmdc",
    "pod_dmdc": "pod_dmdc", "pod_ml": "pod_ml", "pod_ml_ridge": "pod_ml",
    "pod_ml_random_forest": "pod_trees", "pod_ml_rf": "pod_trees",
    "pod_ml_gradient_boosting": "pod_trees", "pod_ml_gb": "pod_trees",
}


def fit_named(name: str, df: DataFrame, spec: TrajectorySpec, *, steps: Factor | None = None,
              snapshots: Factor | None = None, rank=None, pod_rank=0.999, alpha: float = 1e-4,
              center: bool = True, scale: bool = False, trees: int = 100):
    """Fit by registered name; shared factors are reused when given. Centre and scale act on the modes only.

    Tree names read the transitions once more, as trees need the rows; ``trees`` is their number.
    """
    kind = MODEL_NAMES.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown model: {name!r}")
    if kind == "persistence":
        return "persistence"
    if kind == "mean":
        return fit_mean(df, spec.states)
    if kind == "adaptive_dmdc":
        return fit_adaptive(df, spec, rank=rank)
    if kind in ("dmdc", "ridge_dmdc"):
        if name.lower() in ("dmd", "ridge_dmd") and spec.inputs:
            spec = TrajectorySpec(time=spec.time, states=spec.states, case=spec.case, order=spec.order)
        steps = steps or fit_transitions(df, spec)
        return fit_ridge(steps, spec, rank=rank, alpha=alpha) if kind == "ridge_dmdc" else fit_dmdc(steps, spec, rank=rank)
    if kind == "pod_trees":
        from trajmill.operators.trees import TREE_NAMES, fit_tree_model

        pod = fit_pod(snapshots or fit_snapshots(df, spec.states), spec.states, rank=pod_rank, center=center, scale=scale)
        return fit_tree_model(transitions(df, spec), spec, pod, model_type=TREE_NAMES[name.lower()], trees=trees)
    steps = steps or fit_transitions(df, spec)
    snapshots = snapshots or fit_snapshots(df, spec.states)
    if kind == "pod_dmdc":
        return fit_pod_dmdc(steps, snapshots, spec, pod_rank=pod_rank, dmdc_rank=rank, center=center, scale=scale)
    return fit_pod_ridge(steps, snapshots, spec, pod_rank=pod_rank, center=center, scale=scale)


# -- sensor selection ---------------------------------------------------------------------------------------

def sensor_ranking(pod: PODBasis, n_sensors: int | None = None, rank: int | None = None) -> pd.DataFrame:
    """Rank states as sensors by a column-pivoted QR of the transposed modes."""
    phi = pod.modes if rank is None else pod.all_modes[:, :rank]
    n, r = phi.shape
    order, diagonal = L.pivot_order(phi.T)
    wanted = int(min(max(n_sensors or r, 1), n))
    strength = np.linalg.norm(phi, axis=1)
    return pd.DataFrame({
        "rank": np.arange(1, n + 1), "sensor_index": order, "state": [pod.states[i] for i in order],
        "row_norm": strength[order], "pivot_magnitude": [diagonal[i] if i < len(diagonal) else None for i in range(n)],
        "selected": np.arange(n) < wanted})


def measurement_matrix(pod: PODBasis, indices) -> np.ndarray:
    """H of the selected sensors: scale times mode rows."""
    indices = list(indices)
    return pod.spread[indices, None] * pod.modes[indices]
