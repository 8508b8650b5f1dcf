"""A stream of queries against an index at rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hits of each batch of the stream (q_id and what `search` needs), written as Parquet under its batch number, so that a batch that runs again replaces itself."""

    def batch(df: DataFrame, epoch: int) -> None:
        search(df).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
