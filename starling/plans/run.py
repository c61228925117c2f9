"""The whole flow: prepare, scale, reduce, cluster, score, store."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.operators.dbscan import dbscan
from starling.operators.divisive import divisive
from starling.operators.evaluate import calculate_metrics
from starling.operators.hdbscan import hdbscan
from starling.operators.hierarchical import hierarchical
from starling.operators.kmeans import elbow, kmeans
from starling.operators.prepare import impute, missing_as_null, numeric_columns, require_complete, to_features, width
from starling.operators.reduce import reduce_if_wide
from starling.operators.scale import Scaler, fit_scaler
from starling.operators.soft import deep_embedding
from starling.operators.spectral import spectral
from starling.plans.registry import parameters_of, validate
from starling.session import cut_lineage
from starling.sources.store import CenterModel, Store

AUTO_K = ("kmeans", "spectral", "deep_embedding")
SUMMARY_SCHEMA = "dataset string, algorithm string, metrics map<string,double>, error string"


@dataclass
class RunResult:
    algorithm: str
    labels: DataFrame
    metrics: dict[str, Any]
    parameters: dict[str, Any]
    feature_names: list[str]
    scaler: Scaler
    centers: DataFrame | None = None
    experiment_id: str | None = None
    results_id: str | None = None
    details: dict[str, Any] = field(default_factory=dict)

    def model(self) -> CenterModel:
        """Scaler and centres for labelling new rows (centre-based algorithms)."""
        if self.centers is None:
            raise ValueError(f"{self.algorithm} leaves no centres to predict with")
        return CenterModel(self.scaler, self.centers)


def prepare_features(
    df: DataFrame, id_col: str | None = None, exclude: Sequence[str] = (), strategy: str | None = "mean",
    scale: str | None = "standard",
) -> tuple[DataFrame, list[str], Scaler, str, DataFrame]:
    """(feature frame, feature names, scaler, id column, keyed source)."""
    if id_col is None:
        # Ids are made once and written down, so that every later pass, and any
        # retried task, sees the same ones.
        id_col = "row_id"
        df = cut_lineage(df.withColumn(id_col, F.monotonically_increasing_id()))
    names = numeric_columns(df, exclude=[id_col, *exclude])
    if not names:
        raise ValueError("No numeric columns found in the dataset")
    clean = df.select(id_col, *[missing_as_null(df, c).cast("double").alias(c) for c in names])
    if strategy is not None:
        clean = impute(clean, strategy, names)
    require_complete(clean, names)
    scaler = fit_scaler(clean, names, scale)
    return to_features(scaler.transform(clean), names, id_col), names, scaler, id_col, df


def run(
    df: DataFrame,
    algorithm: str = "kmeans",
    *,
    id_col: str | None = None,
    exclude: Sequence[str] = (),
    strategy: str | None = "mean",
    scale: str | None = "standard",
    n_components: int | None = None,
    max_dimensions: int = 1000,
    noise: str = "drop",
    silhouette_mode: str = "exact",
    sample_rows: int = 1000,
    check_parameters: bool = False,
    store: Store | None = None,
    source_name: str | None = None,
    **parameters: Any,
) -> RunResult:
    """Cluster a table and, with a store, keep the run's record and results.

    Without ``n_clusters`` the centre-based algorithms pick k by the elbow.
    Tables wider than ``n_components``, by default ``max_dimensions``, are
    reduced to that many principal components. ``silhouette_mode='sampled'`` keeps the scores linear in the rows.
    """
    experiment_id = store.start_experiment(algorithm, source_name, parameters) if store else None
    try:
        parameters_of(algorithm)
        if check_parameters:
            validate(algorithm, parameters)
        ff, names, scaler, _, _ = prepare_features(df, id_col, exclude, strategy, scale)
        ff = cut_lineage(ff)
        ff, pca = reduce_if_wide(ff, max_dimensions if n_components is None else n_components)
        ff = cut_lineage(ff) if pca is not None else ff
        if algorithm in AUTO_K and parameters.get("n_clusters") is None:
            parameters["n_clusters"] = elbow(ff)[0]
        labelled, centers, extra = _ALGORITHMS[algorithm](ff, **parameters)
        labelled = cut_lineage(labelled.select("row_id", "features", "cluster"))
        metrics = {**calculate_metrics(labelled, noise, silhouette_mode=silhouette_mode, sample_rows=sample_rows), **extra}
        result = RunResult(algorithm, labelled, metrics, dict(parameters), names, scaler, centers, experiment_id)
        if pca is not None:
            result.details["pca"] = pca
        if store:
            numbers = {k: v for k, v in metrics.items() if isinstance(v, (int, float))}
            kept = centers
            if centers is not None and pca is None:  # principal components have no units of the input
                kept = CenterModel(scaler, centers).centers_raw().withColumnRenamed("center_scaled", "center")
            result.results_id = store.save_results(
                labelled, algorithm=algorithm, experiment_id=experiment_id, centers=kept, metrics=numbers, parameters=parameters,
                n_features=len(names), data_shape=(labelled.count(), len(df.columns)), processed_columns=width(labelled),
            )
            store.complete_experiment(experiment_id, result.results_id, numbers)
        return result
    except Exception as error:
        if store:
            store.fail_experiment(experiment_id, str(error))
        raise


def quick(df: DataFrame, n_clusters: int = 3, **options: Any) -> RunResult:
    """K-means with the defaults."""
    return run(df, "kmeans", n_clusters=n_clusters, **options)


def _kmeans(ff, n_clusters, **options):
    fit = kmeans(ff, n_clusters, **options)
    return fit.labels, fit.centers, {"inertia": fit.inertia, "n_iter": fit.n_iter}


def _dbscan(ff, **options):
    fit = dbscan(ff, **options)
    return fit.labels, None, {"noise_ratio": fit.noise_ratio}


def _hierarchical(ff, n_clusters=3, **options):
    fit = hierarchical(ff, n_clusters, **options)
    return fit.labels, None, {"summaries": fit.summaries} if fit.summaries else {}


def _divisive(ff, n_clusters=3):
    fit = divisive(ff, n_clusters)
    return fit.labels, fit.nodes.where("cluster IS NOT NULL").select("cluster", "center"), {}


def _spectral(ff, n_clusters, gamma=1.0, **options):
    fit = spectral(ff, n_clusters, gamma=gamma, **options)
    return fit.labels, None, {"gamma": gamma, "landmarks": fit.landmarks, "exact": fit.exact}


def _hdbscan(ff, **options):
    fit = hdbscan(ff, **options)
    return fit.labels, None, {"cluster_persistence": fit.persistence}


def _deep_embedding(ff, n_clusters, **options):
    fit = deep_embedding(ff, n_clusters, **options)
    # Scored on the latent rows, which is what was clustered.
    return fit.labels, None, {"loss": fit.losses[-1]} if fit.losses else {}


_ALGORITHMS: dict[str, Callable[..., tuple[DataFrame, DataFrame | None, dict[str, Any]]]] = {
    "kmeans": _kmeans,
    "dbscan": _dbscan,
    "hierarchical": _hierarchical,
    "divisive": _divisive,
    "spectral": _spectral,
    "hdbscan": _hdbscan,
    "deep_embedding": _deep_embedding,
}


def run_batch(
    datasets: Mapping[str, DataFrame], algorithms: Sequence[str], store: Store | None = None,
    options: Mapping[str, Mapping[str, Any]] | None = None, parallel: int = 4, **common: Any,
) -> DataFrame:
    """Every data set with every algorithm; a failing cell keeps its error.

    Up to ``parallel`` cells run at a time, each in a job group and, where the
    session schedules fairly (``spark.scheduler.mode=FAIR``), a pool of its own.
    """
    cells = [(name, df, algorithm) for name, df in datasets.items() for algorithm in algorithms]
    spark = next(iter(datasets.values())).sparkSession

    def cell(name: str, df: DataFrame, algorithm: str) -> tuple:
        spark.sparkContext.setJobGroup(f"batch {name} {algorithm}", f"{algorithm} on {name}")
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"batch-{name}-{algorithm}")
        try:
            result = run(df, algorithm, store=store, source_name=name, **common, **(options or {}).get(algorithm, {}))
            numbers = {k: float(v) for k, v in result.metrics.items() if isinstance(v, (int, float))}
            return name, algorithm, numbers, None
        except Exception as error:  # one failing cell must not end the batch
            return name, algorithm, None, str(error)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as threads:
        # The session is handed on: a new thread has no active one of its own.
        rows = list(threads.map(inheritable_thread_target(spark)(lambda c: cell(*c)), cells))
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)
