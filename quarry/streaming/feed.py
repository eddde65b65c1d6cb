"""Re-indexing from a stream of change notices: one incremental build for each micro-batch and index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..operators.library import Library


def follow(notices: DataFrame, library: Library, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """``notices`` is a stream with a column path. Each batch's paths are resolved to the indexes at
    or above them, and those are brought up to date by the same code as any build; so a batch
    that is played again changes nothing."""

    def refresh(batch: DataFrame, _: int) -> None:
        above = catalog.nearest_ancestor(batch.select("path").distinct(), library.entries())
        for row in above.where(F.col("ancestor").isNotNull()).select("ancestor").distinct().collect():  # entries of the catalog
            library.build(row["ancestor"])

    writer = notices.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
