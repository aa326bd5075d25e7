"""New documents as they arrive: each micro-batch runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glosswork.plans.highlights import highlight_documents
from glosswork.sources.pages import pages_of_documents


def requests_once(requests: DataFrame, key: str = "request_key", time: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Requests without those that repeat a key in flight: within the watermark for streams."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if requests.isStreaming else requests.dropDuplicates([key])


def highlight_stream(documents: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Highlights of streamed documents (doc_id, text), appended to path; each batch id is written once, as its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        rows = highlight_documents(pages_of_documents(batch), **options)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
