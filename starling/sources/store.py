"""Datasets, results, experiments and models kept as Parquet tables.

Tables only grow: a change is a new row in a log of numbered commits
(:mod:`starling.sources.log`), and the current state of an id is its row of the
highest version, found with an aggregate. Bulk data is written per id, so
reading one result touches that result's files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.operators.kmeans import assign
from starling.operators.prepare import to_features
from starling.operators.scale import Scaler
from starling.sources.log import VERSION, EventLog

EXPERIMENTS = (
    "id string, algorithm string, filepath string, parameters map<string,string>, started_at timestamp, "
    "completed_at timestamp, status string, error string, results_id string, metrics map<string,double>, recorded_at timestamp"
)
DATASETS = "id string, name string, path string, n_rows long, columns array<string>, metadata map<string,string>, recorded_at timestamp"
RESULTS = (
    "id string, experiment_id string, algorithm string, n_clusters long, n_noise long, parameters map<string,string>, "
    "metrics map<string,double>, n_rows long, n_features int, has_centers boolean, recorded_at timestamp, "
    "data_rows long, data_columns int, processed_columns int"
)
MODELS = (
    "id string, name string, algorithm string, version string, status string, metrics map<string,double>, "
    "parameters map<string,string>, recorded_at timestamp"
)
DELETED = "deleted"


def latest(events: DataFrame, key: str = "id", order: tuple[str, ...] = ("recorded_at",)) -> DataFrame:
    """The last row per key.

    An aggregate rather than a window: partial results keep one row per key
    and task, so a key with very many events does not end up in one sort.
    """
    row = F.struct(*[F.col(c) for c in events.columns if c != key])
    last = events.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in events.columns])


def live_models(events: DataFrame, order: tuple[str, ...] = ("recorded_at",)) -> DataFrame:
    """Latest state per model id, deleted ones left out."""
    return latest(events, order=order).where(F.col("status") != DELETED)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _texts(values: Mapping[str, Any] | None) -> dict[str, str]:
    return {k: str(v) for k, v in (values or {}).items()}


def _numbers(values: Mapping[str, Any] | None) -> dict[str, float]:
    return {k: float(v) for k, v in (values or {}).items() if v is not None}


class Store:
    """A folder of tables below ``base`` (any path Spark can write)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    # -- plumbing

    def _append(self, table: str, schema: str, row: dict[str, Any]) -> None:
        log = EventLog(self.spark, f"{self.base}/{table}", schema)
        log.append(self.spark.createDataFrame([tuple(row.get(n) for n in log.schema.names)], log.schema))

    def _latest(self, table: str, schema: str) -> DataFrame:
        """The row of the highest version per id, in the table's own columns."""
        log = EventLog(self.spark, f"{self.base}/{table}", schema)
        return latest(log.read(), order=(VERSION,)).select(*log.schema.names)

    # -- datasets

    def save_dataset(self, df: DataFrame, name: str, metadata: Mapping[str, Any] | None = None) -> str:
        dataset_id = str(uuid.uuid4())
        path = f"{self.base}/data/{name}_{dataset_id}.parquet"
        df.write.parquet(path)
        rows = self.spark.read.parquet(path).count()
        self._append("datasets", DATASETS, {
            "id": dataset_id, "name": name, "path": path, "n_rows": rows, "columns": df.columns,
            "metadata": _texts(metadata), "recorded_at": _now(),
        })
        return dataset_id

    def list_datasets(self) -> DataFrame:
        return self._latest("datasets", DATASETS)

    def get_dataset(self, dataset_id: str) -> dict[str, Any] | None:
        row = self.list_datasets().where(F.col("id") == dataset_id).first()
        return row.asDict() if row else None

    def load_dataset(self, dataset_id: str) -> DataFrame | None:
        found = self.get_dataset(dataset_id)
        return self.spark.read.parquet(found["path"]) if found else None

    # -- results

    def save_results(
        self, labels: DataFrame, *, algorithm: str, experiment_id: str, centers: DataFrame | None = None,
        metrics: Mapping[str, Any] | None = None, parameters: Mapping[str, Any] | None = None, n_features: int | None = None,
        data_shape: tuple[int, int] | None = None, processed_columns: int | None = None,
    ) -> str:
        """Write assignments (and centres) under a new id, then the result's row.

        ``data_shape`` holds the input's rows and columns, ``processed_columns``
        the features that were clustered, of as many rows as have a label.

        The row comes last, so a reader never finds a result half written.
        """
        results_id = str(uuid.uuid4())
        labels.select("row_id", "cluster").write.parquet(f"{self.base}/assignments/{results_id}")
        if centers is not None:
            centers.write.parquet(f"{self.base}/centers/{results_id}")
        metrics = dict(metrics or {})
        self._append("results", RESULTS, {
            "id": results_id, "experiment_id": experiment_id, "algorithm": algorithm,
            "n_clusters": metrics.get("n_clusters"), "n_noise": metrics.get("n_noise"), "parameters": _texts(parameters),
            "metrics": _numbers(metrics), "n_rows": metrics.get("n_samples"), "n_features": n_features,
            "has_centers": centers is not None, "recorded_at": _now(), "processed_columns": processed_columns,
            "data_rows": data_shape[0] if data_shape else None, "data_columns": data_shape[1] if data_shape else None,
        })
        return results_id

    def list_results(self) -> DataFrame:
        return self._latest("results", RESULTS)

    def load_results(self, results_id: str) -> dict[str, Any] | None:
        """Summary fields plus ``assignments`` and ``centers`` frames; None if absent."""
        row = self.list_results().where(F.col("id") == results_id).first()
        if row is None:
            return None
        found = row.asDict()
        found["assignments"] = self.spark.read.parquet(f"{self.base}/assignments/{results_id}")
        found["centers"] = self.spark.read.parquet(f"{self.base}/centers/{results_id}") if row["has_centers"] else None
        return found

    def results_summary(self, results_id: str) -> DataFrame:
        """One row of headline numbers for a result."""
        metric = lambda name: F.try_element_at("metrics", F.lit(name)).alias(name)
        return self.list_results().where(F.col("id") == results_id).select(
            "id", "algorithm", "n_clusters", "n_noise", "n_rows", "n_features",
            metric("silhouette_score"), metric("calinski_harabasz_score"), F.col("recorded_at").alias("created_at"),
        )

    def export_results(self, results_id: str, original: DataFrame, id_col: str, path: str, fmt: str = "csv") -> None:
        """Write the original columns plus ``cluster`` of a stored result to ``path``."""
        found = self.load_results(results_id)
        if found is None:
            raise ValueError(f"no such result: {results_id}")
        write_labelled(original, found["assignments"], id_col, path, fmt)

    # -- experiments

    def start_experiment(self, algorithm: str, filepath: str | None, parameters: Mapping[str, Any] | None = None) -> str:
        experiment_id = str(uuid.uuid4())
        self._append("experiments", EXPERIMENTS, {
            "id": experiment_id, "algorithm": algorithm, "filepath": filepath, "parameters": _texts(parameters),
            "started_at": _now(), "status": "running", "metrics": {}, "recorded_at": _now(),
        })
        return experiment_id

    def complete_experiment(self, experiment_id: str, results_id: str, metrics: Mapping[str, Any] | None = None) -> None:
        self._finish(experiment_id, status="completed", results_id=results_id, metrics=_numbers(metrics))

    def fail_experiment(self, experiment_id: str, error: str) -> None:
        self._finish(experiment_id, status="failed", error=error)

    def _finish(self, experiment_id: str, **changes: Any) -> None:
        row = self.get_experiment(experiment_id)
        if row is None:
            raise ValueError(f"no such experiment: {experiment_id}")
        self._append("experiments", EXPERIMENTS, {**row, "completed_at": _now(), "recorded_at": _now(), **changes})

    def list_experiments(self) -> DataFrame:
        return self._latest("experiments", EXPERIMENTS)

    def get_experiment(self, experiment_id: str) -> dict[str, Any] | None:
        row = self.list_experiments().where(F.col("id") == experiment_id).first()
        return row.asDict() if row else None

    # -- models

    def save_model_metadata(
        self, name: str, algorithm: str, version: str = "1", metrics: Mapping[str, Any] | None = None,
        parameters: Mapping[str, Any] | None = None, model_id: str | None = None,
    ) -> str:
        model_id = model_id or str(uuid.uuid4())
        self._append("models", MODELS, {
            "id": model_id, "name": name, "algorithm": algorithm, "version": version, "status": "ready",
            "metrics": _numbers(metrics), "parameters": _texts(parameters), "recorded_at": _now(),
        })
        return model_id

    def list_models(self) -> DataFrame:
        return self._latest("models", MODELS).where(F.col("status") != DELETED)

    def get_model_metadata(self, model_id: str) -> dict[str, Any] | None:
        row = self.list_models().where(F.col("id") == model_id).first()
        return row.asDict() if row else None

    def delete_model(self, model_id: str) -> bool:
        row = self.get_model_metadata(model_id)
        if row is None:
            return False
        self._append("models", MODELS, {**row, "status": DELETED, "recorded_at": _now()})
        return True

    def save_model(self, model: CenterModel, model_id: str) -> None:
        model.scaler.to_frame(self.spark).write.mode("overwrite").parquet(f"{self.base}/models_data/{model_id}/scaler")
        model.centers.write.mode("overwrite").parquet(f"{self.base}/models_data/{model_id}/centers")

    def load_model(self, model_id: str) -> CenterModel | None:
        path = f"{self.base}/models_data/{model_id}"
        try:
            scaler = self.spark.read.parquet(f"{path}/scaler")
            centers = self.spark.read.parquet(f"{path}/centers")
        except AnalysisException:
            return None
        return CenterModel(Scaler.from_frame(scaler), centers)


class CenterModel:
    """A fitted scaler with cluster centres: labels new rows."""

    def __init__(self, scaler: Scaler, centers: DataFrame):
        self.scaler = scaler
        self.centers = centers

    def features(self, df: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return to_features(self.scaler.transform(df), self.scaler.columns, id_col, keep)

    def predict(self, df: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """``(row_id, cluster, distance, <kept columns>)``."""
        return assign(self.features(df, id_col, keep), self.centers).select("row_id", "cluster", "distance", *keep)

    def centers_raw(self) -> DataFrame:
        """Centres in scaled space and in the units of the input."""
        spans = F.array(*[F.lit(s) for s in self.scaler.divisors])
        middles = F.array(*[F.lit(m) for m in self.scaler.centers])
        stretched = F.zip_with("center", spans, lambda c, s: c * s)
        return self.centers.select(
            "cluster", F.col("center").alias("center_scaled"), F.zip_with(stretched, middles, lambda c, m: c + m).alias("center_raw")
        )


def write_labelled(original: DataFrame, labels: DataFrame, id_col: str, path: str, fmt: str = "csv") -> None:
    """Original columns plus ``cluster``, joined on the id and never on position."""
    joined = original.join(labels.select(F.col("row_id").alias(id_col), "cluster"), id_col).select(*original.columns, "cluster")
    writer = joined.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported file format: {fmt}")


def write_labels(labels: DataFrame, path: str) -> None:
    """The labels alone, keyed by row id."""
    labels.select("row_id", F.col("cluster").alias("cluster_label")).write.mode("overwrite").csv(path, header=True)


__all__ = ["CenterModel", "Store", "latest", "live_models", "write_labelled", "write_labels"]
