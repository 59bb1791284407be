"""The same change detection over a stream of captured pages, one micro-batch a run."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import pipeline
from ..sources import store


def watch(pages: DataFrame, root: str, checkpoint: str, rules: Mapping, today: Callable[[], str], sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts a query that runs the pipeline on each batch of pages, against the state under root.

    sink takes a batch's items and number before the state moves on, so a crash between them reports a batch
    again rather than never. An empty batch changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        done = pipeline.run(batch, None, store.load_state(batch.sparkSession, root), rules, today())
        sink(done.items, number)
        store.save_state(done.state, root)
        done.close()

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
