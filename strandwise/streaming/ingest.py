"""Pages that arrive over time: each micro-batch's new titles are answered and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandwise.config import Settings
from strandwise.operators.rank import first_by
from strandwise.plans.extraction import _existing, append_answered, unprocessed
from strandwise.sources.llm_client import Client


def ingest_pages(pages: DataFrame, make_client: Callable[[], Client], settings: Settings, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append parsed answers of a stream of ``pages(title, text, ord)`` to ``path``.

    A title that ``path`` has is skipped, so a batch that runs again after a failure, and titles that come again,
    add nothing; a title of which the model left a chunk unanswered isn't added, and asked when it comes again; build the graph from ``path`` with ``extraction.build_graph``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = first_by(batch, ["title"], [F.col("ord")])
        append_answered(spark, unprocessed(once, _existing(spark, path)), make_client, settings, path)

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
