"""Continuous ingest: a stream of definitions into a vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.store import VectorStore


def batch_writer(store: VectorStore, name: str):
    """A ``foreachBatch`` function that commits each batch exactly once.

    The number of the last batch is a variable of the store that is written in the batch's own commit, so that a batch
    that runs again after a failure is left out if its commit had been made, and made if not.
    """
    key = f"stream:{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        store.refresh()
        done = store.variable(key)
        if done and int(done) >= batch_id:
            return
        tx = store.transaction()
        tx.define_frame(batch)
        tx.set_variable(key, str(batch_id))
        tx.commit()

    return write


def ingest(stream: DataFrame, store: VectorStore, name: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Starts the ingest of a stream of ``(seq, type, feature, vec)``; ``once`` stops it when all input is read."""
    writer = stream.writeStream.foreachBatch(batch_writer(store, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
