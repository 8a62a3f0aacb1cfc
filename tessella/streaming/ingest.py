"""Continuous ingestion: a stream of staged name/value rows becomes cells in a state store, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import Ingested, from_staged
from ..sources.state import StateStore

STAGED = "source_id long, entity_id long, name string, value string"


def ingest_stream(staged: DataFrame, store: StateStore, checkpoint: str) -> StreamingQuery:
    """Starts ingestion of (source_id, entity_id, name, value).

    Each batch is a part of its own, by its number: a batch that runs again replaces its own rows and no others. Sources,
    fields and entities that several batches hold stand in each of them with equal rows; ``ingested`` reads them once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        # The four tables are made of the batch's rows, which are read from the source once.
        rows = rows.persist()
        got = from_staged(rows)
        with store.transaction():
            for name, part in (("local_sources", got.sources), ("local_fields", got.fields), ("local_entities", got.entities), ("local_data", got.cells)):
                store.put(name, f"batch{number:09d}", part)
        rows.unpersist()

    return staged.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(store: StateStore) -> Ingested:
    """What all batches brought."""
    return Ingested(*(store.read(t).distinct() for t in ("local_sources", "local_fields", "local_entities")), store.read("local_data"))


def windowed_counts(cells: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, name, n) of a stream with a time column; rows later than the watermark are left out."""
    return cells.withWatermark(time, late).groupBy(F.window(time, width), "name").agg(F.count("*").alias("n"))
