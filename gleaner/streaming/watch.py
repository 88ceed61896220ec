"""Keep a bundle up to date from a stream of document batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import KEY
from ..plans.engine import Engine


def watch(engine: Engine, documents: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert each micro-batch of documents (the shape of a scan, with content_hash); nothing counts as deleted.

    A batch becomes a segment of the bundle, compared only with the state of the files that it names; of a file that
    comes more than once in a batch the last by time counts.  The manifest keeps the stream's name and the number of its last batch, so a batch that is
    replayed after a failure does nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        seen = engine.bundle.manifest().get("streams", {})
        if seen.get(checkpoint, -1) >= number:
            return
        own = [c for c in batch.columns if c not in KEY]
        newest = batch.groupBy(*KEY).agg(F.max_by(F.struct(*own), F.struct("modified_at", "content_hash")).alias("_x")).select(*KEY, "_x.*")
        engine.upsert(newest.select(*batch.columns), streams=seen | {checkpoint: number})

    return documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
