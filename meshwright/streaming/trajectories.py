"""Graphs of trajectory frames as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.points import cutoff_graph


def edges_of_frames(points: DataFrame, r_max: float, path: str, checkpoint: str) -> StreamingQuery:
    """Write the cutoff edges of every arriving batch of whole frames; frames do not straddle batches."""

    def each(batch: DataFrame, number: int) -> None:
        cutoff_graph(batch, r_max, ("frame",)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
