"""Change rows as a stream: each micro-batch extends the set of affected files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators import graph


def watch(changes: DataFrame, edges: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls ``sink`` with (path, depth) of what each batch of changes (path) affects, by ``edges``."""

    def batch(df: DataFrame, number: int) -> None:
        seeds = df.select(F.col("path").alias("id")).where("id is not null").distinct()
        sink(graph.reachable_from(df.sparkSession, seeds, edges).select(F.col("id").alias("path"), "depth"), number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
