"""Tree ensembles on modal coefficients: trained by Spark ML, flattened to arrays, rolled out for all cases of a task together."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trajmill.operators.fitting import PODBasis, modal_features
from trajmill.plans.segments import cluster, plan_layout, with_lags, with_position
from trajmill.spec import TrajectorySpec

LARGEST = 256 << 20  # bytes of a flattened model; trees, depth and modes bound it, not the data

# Accepted names of tree models.
TREE_NAMES = {
    "pod_ml_random_forest": "random_forest", "pod_ml_rf": "random_forest",
    "pod_ml_gradient_boosting": "gradient_boosting", "pod_ml_gb": "gradient_boosting",
}


@dataclass
class Forest:
    """One ensemble as arrays over all its nodes; a leaf is its own child, so walking past it changes nothing."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of the trees for every row of ``x``: all rows go down all trees level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.value[at] @ self.weights

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.cut, self.left, self.right, self.value))


_TREE = re.compile(r"Tree \d+ \(weight ([^)]+)\):")
_SPLIT = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


def flatten(model) -> Forest:
    """The nodes of a Spark ensemble, read from its printed form, whose numbers are exact."""
    feature, cut, left, right, value, roots, weights = [], [], [], [], [], [], []
    open_nodes: list[int] = []  # inner nodes that wait for their right child

    def hang(node: int) -> None:
        if node == roots[-1]:
            return
        parent = open_nodes[-1]
        if left[parent] < 0:
            left[parent] = node
        else:
            right[parent] = node
            open_nodes.pop()

    for line in model.toDebugString.splitlines():
        line = line.strip()
        if found := _TREE.match(line):
            weights.append(float(found[1]))
            roots.append(len(feature))
            open_nodes.clear()
        elif found := _SPLIT.match(line):
            node = len(feature)
            feature.append(int(found[1]))
            cut.append(float(found[2]))
            left.append(-1)
            right.append(-1)
            value.append(0.0)
            hang(node)
            open_nodes.append(node)
        elif line.startswith("Predict:"):
            node = len(feature)
            feature.append(0)
            cut.append(0.0)
            left.append(node)
            right.append(node)
            value.append(float(line.removeprefix("Predict:")))
            hang(node)
    share = np.array(weights) if "GBT" in type(model).__name__ else np.full(len(weights), 1.0 / max(1, len(weights)))
    forest = Forest(np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(right, np.int32), np.array(value),
                    np.array(roots, np.int32), share, 0)
    forest.depth = _depth(forest)
    return forest


def _depth(forest: Forest) -> int:
    """Levels below the roots."""
    at, depth = forest.roots, 0
    while len(at := np.unique(np.concatenate([forest.left[at], forest.right[at]])[np.tile(forest.left[at] != at, 2)])):
        depth += 1
    return depth


@dataclass
class TreeModel:
    """One ensemble per modal coefficient, on features (modal state, inputs)."""

    kind: str
    states: list[str]
    inputs: list[str]
    pod: PODBasis
    forests: list[Forest]
    metadata: dict = field(default_factory=dict)

    def next_modal(self, modal: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        x = np.column_stack([modal, inputs]) if self.inputs else modal
        return np.column_stack([f.predict(x) for f in self.forests])


def fit_tree_model(steps: DataFrame, spec: TrajectorySpec, pod: PODBasis, *, model_type: str = "random_forest", trees: int = 100,
                   seed: int = 0, max_depth: int | None = None) -> TreeModel:
    """Train one Spark ensemble per mode on the transitions ``steps`` and flatten it."""
    ensembles = train_ensembles(steps, spec, pod, model_type=model_type, trees=trees, seed=seed, max_depth=max_depth)
    forests = [flatten(m) for m in ensembles]
    if sum(f.nbytes for f in forests) > LARGEST:
        raise ValueError(f"the flattened trees exceed {LARGEST >> 20} MB: use fewer or shallower trees")
    return TreeModel(f"pod_ml_{model_type}", list(spec.states), list(spec.inputs), pod, forests, {"trees": trees, "pod_rank": pod.rank})


def train_ensembles(steps: DataFrame, spec: TrajectorySpec, pod: PODBasis, *, model_type: str = "random_forest", trees: int = 100,
                    seed: int = 0, max_depth: int | None = None) -> list:
    """One Spark tree ensemble per mode, trained on the executors."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    names = [f"a{i + 1}" for i in range(pod.rank)]
    assembled = VectorAssembler(inputCols=[*names, *spec.inputs], outputCol="features").transform(modal_features(steps, spec, pod))
    ready = assembled.select("features", *[f"next_{c}" for c in names]).persist()
    makers = {
        "random_forest": lambda y: RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=trees, seed=seed, maxDepth=max_depth or 5),
        "gradient_boosting": lambda y: GBTRegressor(featuresCol="features", labelCol=y, seed=seed, maxIter=trees, maxDepth=max_depth or 3),
    }
    if model_type not in makers:
        raise ValueError(f"unknown tree model: {model_type!r}")
    try:
        return [makers[model_type](f"next_{c}").setPredictionCol(f"pred_{c}").fit(ready) for c in names]
    finally:
        ready.unpersist()


def rollout_trees(df: DataFrame, spec: TrajectorySpec, model: TreeModel, *, steps: int | None = None, keep: list[str] | None = None,
                  prefix: str = "pred_") -> DataFrame:
    """Free run of every case from its first row under its recorded inputs, for all rows or the first ``steps`` after it.

    A task holds whole cases and sees their rows ordered by position: all cases take step k together, as one walk down the trees, and only
    their present modal states are kept. The steps of one case cannot be cut into segments, as trees are no linear map; a case is stepped in one
    task, which streams its rows.
    """
    keep = list(dict.fromkeys(keep or [*spec.keys, spec.time, *spec.order, *spec.states]))
    layout = plan_layout(df, spec.keys, spec.time)
    needed = list(dict.fromkeys([*keep, *spec.keys, *spec.sort, *model.states, *model.inputs]))
    placed = with_position(cluster(df.select(*needed), layout), layout, spec.sort)
    lagged = with_lags(placed, layout, spec.sort, {f"_u_{c}": (c, 1) for c in model.inputs}) if model.inputs else placed
    if steps is not None:
        lagged = lagged.where(F.col("_k") <= steps)
    dealt = lagged if not layout.split else lagged.repartition(*spec.keys) if spec.keys else lagged.repartition(1)
    ordered = dealt.sortWithinPartitions("_k", *spec.keys)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    key = spec.case

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pod = shared.value, shared.value.pod
        cases, state = pd.Index([]), np.empty((0, pod.rank))
        for frame in frames:
            modal = np.empty((len(frame), pod.rank))
            position = frame["_k"].to_numpy()
            u = frame[[f"_u_{c}" for c in known.inputs]].to_numpy(float)
            edges = [0, *(np.flatnonzero(np.diff(position)) + 1).tolist(), len(frame)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                here = pd.Index(frame[key].iloc[lo:hi]) if key else pd.Index(np.zeros(hi - lo, int))
                if position[lo] == 0:
                    x0 = frame[known.states].iloc[lo:hi].to_numpy(float)
                    modal[lo:hi] = (x0 - pod.mean) / pod.spread @ pod.modes
                    cases = here if not len(cases) else cases.append(here)
                    state = np.concatenate([state, modal[lo:hi]])
                else:
                    at = cases.get_indexer(here)
                    modal[lo:hi] = state[at] = known.next_modal(state[at], u[lo:hi])
            values = modal @ pod.modes.T * pod.spread + pod.mean
            yield frame[[*keep, "_k"]].assign(**{f"{prefix}{c}": values[:, i] for i, c in enumerate(known.states)})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, "_k"]) + "".join(f", `{prefix}{c}` double" for c in model.states)
    return ordered.mapInPandas(run, schema)


def predict_next_trees(df: DataFrame, spec: TrajectorySpec, model: TreeModel, prefix: str = "pred_") -> DataFrame:
    """Add the next full state of every row; rows are independent, nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pod = shared.value, shared.value.pod
        for frame in frames:
            modal = (frame[known.states].to_numpy(float) - pod.mean) / pod.spread @ pod.modes
            values = known.next_modal(modal, frame[known.inputs].to_numpy(float)) @ pod.modes.T * pod.spread + pod.mean
            yield frame.assign(**{f"{prefix}{c}": values[:, i] for i, c in enumerate(known.states)})

    return df.mapInPandas(step, kinds + "".join(f", `{prefix}{c}` double" for c in model.states))
