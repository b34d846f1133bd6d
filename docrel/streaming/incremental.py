"""Incremental loads: only documents beyond the last key, by batch or by a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.load import Catalog, LoadStats, load, load_watermark
from ..plans.nesting import Plan
from ..sources.documents import after, from_table


def load_new(table: DataFrame, key: str, plan: Plan, catalog: Catalog) -> LoadStats:
    """Loads the rows of a typed table whose key lies beyond the saved mark and moves the mark, in one commit. Changes
    to rows below the mark are not seen."""
    mark = load_watermark(catalog, plan.collection)
    docs = from_table(after(table, key, mark).withColumnRenamed(key, "_id"), "_id")
    return load(docs, plan, catalog, mode="full" if mark is None else "incremental", watermark=True)


def load_stream(stream: DataFrame, key: str, plan: Plan, catalog: Catalog, checkpoint: str):
    """A streaming query that upserts each batch of a typed stream and ends when it has read what is there."""

    def batch(df: DataFrame, _: int) -> None:
        docs = from_table(df.withColumnRenamed(key, "_id"), "_id")
        load(docs, plan, catalog, mode="incremental", watermark=True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


