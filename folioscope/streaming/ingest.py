"""Files that keep arriving, ingested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioscope.plans.ingest import ingest
from folioscope.sources.files import Parser
from folioscope.sources.index import Collection


def start_ingest(
    files: DataFrame, collection: Collection, parser: Parser, checkpoint: str, **options
) -> StreamingQuery:
    """Ingest all files available now from a stream of ``(path, file_name, content)``.

    A batch that is run again after a failure finds its files in the ledger, or
    overwrites what the failed attempt had written, so the result is that of one run.
    """

    def add(batch: DataFrame, _batch_id: int) -> None:
        ingest(batch, collection, parser, **options)

    return (
        files.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
