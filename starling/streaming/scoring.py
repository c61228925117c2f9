"""Labelling and updating clusters on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starling.operators.kmeans import assign
from starling.operators.moments import group_moments
from starling.sources.log import Folder
from starling.sources.store import CenterModel

STATE_SCHEMA = "cluster int, center array<double>, n long"


def score_stream(stream: DataFrame, model: CenterModel, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cluster and distance per arriving row.

    A projection with the model's scaler and centres in it: no state, so no
    watermark, and late rows are scored like any other.
    """
    return model.predict(stream, id_col, keep)


def write_stream(scored: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Exactly-once Parquet sink for a scored stream."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class StreamingCenters:
    """Centres with row counts, one version per micro-batch.

    The state is k rows. Version b is computed from the newest version before
    b and written under b's own path, so a replayed batch writes the same
    thing again and counts nothing twice. The newest ``keep`` versions stay;
    which there are is read from the folder's names, not from the files.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        if keep < 2:
            raise ValueError("keep at least two versions: a batch may be replayed")
        self.spark = spark
        self.path = path.rstrip("/")
        self.keep = keep
        self._folder = Folder(spark, self.path)

    def start(self, centers: DataFrame) -> None:
        """Version -1: the given centres with no rows seen."""
        state = centers.select("cluster", "center", F.lit(0).cast("long").alias("n"))
        state.coalesce(1).write.mode("overwrite").parquet(self._version(-1))

    def _version(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def versions(self) -> list[int]:
        """The stored versions, a half written one left out."""
        named = [int(n.removeprefix("batch=")) for n in self._folder.names() if n.startswith("batch=")]
        return sorted(v for v in named if any(n.endswith(".parquet") for n in Folder(self.spark, self._version(v)).names()))

    def before(self, batch: int) -> DataFrame:
        """The newest version before ``batch``."""
        return self._newest([v for v in self.versions() if v < batch])

    def latest(self) -> DataFrame:
        """The newest version."""
        return self._newest(self.versions())

    def _newest(self, versions: list[int]) -> DataFrame:
        if not versions:
            raise ValueError(f"no centres stored below {self.path}")
        return self.spark.read.schema(STATE_SCHEMA).parquet(self._version(versions[-1]))

    def update(self, features: DataFrame, batch: int) -> None:
        """Move each centre to the running mean of all rows it has taken."""
        state = self.before(batch)
        moved = group_moments(assign(features, state.select("cluster", "center")), dims=self._dims(state)).select(
            "cluster", F.col("center").alias("mean"), F.col("n").alias("m")
        )
        mean = F.zip_with("center", "mean", lambda c, x: (c * F.col("n") + x * F.col("m")) / (F.col("n") + F.col("m")))
        merged = state.join(moved, "cluster", "left").select(
            "cluster",
            F.when(F.col("m").isNull(), F.col("center")).otherwise(mean).alias("center"),
            (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"),
        )
        merged.coalesce(1).write.mode("overwrite").parquet(self._version(batch))
        for old in self.versions()[: -self.keep]:
            self._folder.delete(f"batch={old}")

    @staticmethod
    def _dims(state: DataFrame) -> int:
        return len(state.first()["center"])


def minibatch_kmeans_stream(
    stream: DataFrame, to_features: Callable[[DataFrame], DataFrame], centers: DataFrame, path: str, checkpoint: str,
    available_now: bool = False,
) -> tuple[StreamingQuery, StreamingCenters]:
    """Mini-batch k-means: centres follow the stream, micro-batch by micro-batch.

    ``to_features`` turns a batch into a feature frame (e.g. a model's scaler).
    """
    state = StreamingCenters(stream.sparkSession, path)
    state.start(centers)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state.update(to_features(batch), batch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(), state
