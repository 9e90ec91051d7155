"""Appending rows to an index, batch by batch, and streams of them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import ivf
from tessera.sources import index as source
from tessera.sources.index import Index, publish, write_rows


def append(index: Index, batch: DataFrame, id_column: str = "_row_id", batch_id: str | None = None) -> None:
    """Add rows as a part of its own, which counts once all of it is written.

    Ids up to the last one of the index are finished and an error. A batch_id that was published before is left out, so a
    batch may be tried again; one that failed halfway is written anew. New vectors of clustered fields go to the clusters
    that there are; compact() finds new ones.
    """
    spark, path = index.spark, index.path
    index = Index(spark, path)
    part = f"a{len(index.parts)}" if batch_id is None else f"b{batch_id}"
    if part in index.parts or batch.isEmpty():
        return
    finished = batch.agg(F.min(id_column)).first()[0]
    if finished is not None and finished <= index.last:
        raise ValueError(f"row id {finished} is finished: the index ends at {index.last}")
    rows, last = write_rows(batch, index.fields, path, part, index.last + 1, id_column)
    for f in index.fields.values():
        if source.clustered(f):
            made = index._ivf(f)
            ivf.save_postings(ivf.assigned(made, rows, vector_column=f.name), f"{path}/vectors/{f.name}", part)
    publish(spark, path, part, last)


def ingest(index: Index, stream: DataFrame, checkpoint: str, id_column: str = "_row_id", **trigger) -> StreamingQuery:
    """Append each micro-batch of a stream under its checkpoint and number; trigger as for DataStreamWriter.trigger."""
    name = f"{zlib.crc32(checkpoint.encode()):08x}"
    writer = stream.writeStream.foreachBatch(lambda batch, n: append(index, batch, id_column, f"{name}-{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
