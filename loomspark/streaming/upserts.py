"""A streaming sink: every micro-batch of a stream of documents is upserted into a collection as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomspark.database import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that upserts (id, vector, metadata, content) rows.

    A batch that is run again after a failure changes nothing: the collection remembers the last batch of each checkpoint.
    trigger: as for DataStreamWriter.trigger; availableNow if none is given.
    """

    def apply(batch: DataFrame, number: int) -> None:
        collection.upsert_frame(batch, source=(checkpoint, number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
