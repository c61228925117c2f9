"""The algorithms by name, their parameters and the limits those must keep."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


# Defaults and limits users of these algorithms rely on.
_CLUSTERS = Parameter("n_clusters", int, 8, 2, 100)
ALGORITHMS: dict[str, tuple[Parameter, ...]] = {
    "kmeans": (_CLUSTERS, Parameter("max_iter", int, 300, 1, 1000), Parameter("tol", float, 1e-4, 1e-6, 1e-2)),
    "dbscan": (Parameter("eps", float, 0.5, 0.1, 2.0), Parameter("min_samples", int, 5, 1, 50)),
    "hierarchical": (
        Parameter("n_clusters", int, 3, 2, 100),
        Parameter("linkage", str, "ward", choices=("ward", "average", "complete", "single")),
    ),
    "divisive": (Parameter("n_clusters", int, 3, 2, 100),),
    "spectral": (_CLUSTERS, Parameter("gamma", float, 1.0, 0.1, 10.0)),
    "deep_embedding": (_CLUSTERS, Parameter("latent_dim", int, 10, 2, 100), Parameter("alpha", float, 1.0, 0.1, 10.0)),
    "hdbscan": (Parameter("min_cluster_size", int, 5, 2, 100), Parameter("min_samples", int, None, 1, 50)),
}


def parameters_of(algorithm: str) -> tuple[Parameter, ...]:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    return ALGORITHMS[algorithm]


def validate(algorithm: str, given: Mapping[str, Any]) -> dict[str, Any]:
    """All parameters with defaults filled in; raises on a bad name, type or value."""
    known = {p.name: p for p in parameters_of(algorithm)}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"Unknown parameters for {algorithm}: {unknown}")
    result = {}
    for name, p in known.items():
        value = given.get(name, p.default)
        if value is not None:
            if p.kind is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if not isinstance(value, p.kind) or isinstance(value, bool):
                raise ValueError(f"{name} must be of type {p.kind.__name__}")
            if p.choices and value not in p.choices:
                raise ValueError(f"{name} must be one of {p.choices}")
            if (p.low is not None and value < p.low) or (p.high is not None and value > p.high):
                raise ValueError(f"{name} must lie in {p.low}..{p.high}")
        result[name] = value
    return result


def registry_frame(spark: SparkSession) -> DataFrame:
    """The registry as a table: one row per algorithm and parameter."""
    text = lambda v: None if v is None else str(v)
    rows = [
        (a, p.name, p.kind.__name__, text(p.default), None if p.low is None else float(p.low), None if p.high is None else float(p.high))
        for a, parameters in ALGORITHMS.items() for p in parameters
    ]
    return spark.createDataFrame(rows, "algorithm string, parameter string, type string, default_value string, low double, high double")
