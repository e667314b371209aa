"""Model tables: matrices as arrays in Parquet, versions, stages and deployments."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trajmill.functions.columns import slug
from trajmill.operators.fitting import LinearModel, PODBasis

MODEL_SCHEMA = (
    "name string, version string, kind string, states array<string>, inputs array<string>, a array<array<double>>, "
    "b array<array<double>>, `offset` array<double>, dt double, pod_states array<string>, pod_mean array<double>, "
    "pod_spread array<double>, pod_modes array<array<double>>, pod_singular_values array<double>, pod_rows bigint, "
    "metadata string, notes string, registered_utc string")
DEPLOY_SCHEMA = "name string, stage string, version string, promoted_utc string"


class UnknownModel(ValueError):
    """No such model, version or stage."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def model_row(model: LinearModel, name: str, version: str, notes: str | None = None) -> tuple:
    pod = model.pod
    return (slug(name), slug(version), model.kind, model.states, model.inputs, model.a.tolist(), model.b.tolist(),
            model.offset.tolist(), model.dt, *(
                (pod.states, pod.mean.tolist(), pod.spread.tolist(), pod.modes.tolist(), pod.singular_values.tolist(), pod.rows)
                if pod is not None else (None,) * 6),
            json.dumps(model.metadata, default=float), notes, _now())


def model_from_row(row) -> LinearModel:
    pod = None
    if row["pod_states"] is not None:
        modes = np.array(row["pod_modes"])
        pod = PODBasis(list(row["pod_states"]), np.array(row["pod_mean"]), np.array(row["pod_spread"]), modes,
                       np.array(row["pod_singular_values"]), row["pod_rows"], modes)
    n = len(row["a"])
    b = np.array(row["b"], float).reshape(n, len(row["inputs"]))
    return LinearModel(row["kind"], list(row["states"]), list(row["inputs"]), np.array(row["a"], float), b,
                       np.array(row["offset"], float), row["dt"], json.loads(row["metadata"] or "{}"), pod)


class ModelTable:
    """Append-only model and deployment tables in one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, row: tuple, schema: str, table: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def register(self, model: LinearModel, name: str, version: str | None = None, stage: str = "candidate",
                 notes: str | None = None) -> str:
        """Store a model and deploy it at ``stage``; returns its version."""
        version = slug(version or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ"))
        self._append(model_row(model, name, version, notes), MODEL_SCHEMA, "models")
        self._append((slug(name), stage, version, _now()), DEPLOY_SCHEMA, "deployments")
        return version

    def promote(self, name: str, version: str, stage: str = "production") -> None:
        if self.models().where((F.col("name") == name) & (F.col("version") == version)).isEmpty():
            raise UnknownModel(f"no model {name!r} with version {version!r}")
        self._append((name, stage, version, _now()), DEPLOY_SCHEMA, "deployments")

    def models(self) -> DataFrame:
        """Newest row of each name and version."""
        return latest_versions(self.spark.read.schema(MODEL_SCHEMA).parquet(f"{self.root}/models"))

    def deployments(self) -> DataFrame:
        return current_deployments(self.spark.read.schema(DEPLOY_SCHEMA).parquet(f"{self.root}/deployments"))

    def resolve(self, name: str, stage: str = "production", version: str | None = None) -> LinearModel:
        if version is None:
            row = self.deployments().where((F.col("name") == name) & (F.col("stage") == stage)).first()
            if row is None:
                raise UnknownModel(f"nothing deployed for {name!r} at stage {stage!r}")
            version = row["version"]
        row = self.models().where((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise UnknownModel(f"no model {name!r} with version {version!r}")
        return model_from_row(row)


def predict_saved(store: ModelTable, df: DataFrame, spec, name: str, stage: str = "production",
                  version: str | None = None) -> DataFrame:
    """Roll a stored model out over every case of a table."""
    from trajmill.operators.prediction import rollout

    return rollout(df, spec, store.resolve(name, stage, version))


def _newest(df: DataFrame, keys: list[str], moment: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(moment).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_versions(models: DataFrame) -> DataFrame:
    return _newest(models, ["name", "version"], "registered_utc")


def current_deployments(deployments: DataFrame) -> DataFrame:
    """One version per name and stage: the last promotion wins."""
    return _newest(deployments, ["name", "stage"], "promoted_utc")
