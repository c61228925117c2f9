import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from starling.operators.prepare import to_features  # noqa: E402
from starling.operators.scale import fit_scaler  # noqa: E402

COLUMNS = [f"feature_{i}" for i in range(1, 6)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("starling-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    """300 rows in three clusters, drawn with numpy's legacy generator."""
    rng = np.random.RandomState(42)
    plane = np.vstack([rng.normal(mean, 0.8, (100, 2)) for mean in ((2, 2), (6, 6), (2, 6))])
    third = plane[:, 0] + plane[:, 1] + rng.normal(0, 0.1, 300)
    fourth = plane[:, 0] * plane[:, 1] + rng.normal(0, 0.5, 300)
    data = np.column_stack([plane, third, fourth, rng.normal(0, 1, 300)])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], ["row_id", *COLUMNS]).persist()


@pytest.fixture(scope="session")
def golden_ff(golden):
    frame = to_features(fit_scaler(golden, COLUMNS).transform(golden), COLUMNS, "row_id").persist()
    frame.count()
    return frame


def frame_of(spark, values):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(values)], "row_id long, features array<double>"
    )


def matrix_of(ff):
    return np.array([r["features"] for r in ff.orderBy("row_id").collect()])


def labels_of(labelled):
    return np.array([r["cluster"] for r in labelled.orderBy("row_id").select("cluster").collect()])
