"""Documents as a stream: arrival, deduplication, status, review events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from recordloom.sources.writers import replaced

#: A digest is remembered this long; state is bounded by the arrivals of that time.
REMEMBER = "30 days"


def arrivals(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1000) -> DataFrame:
    """JSON files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def deduplicated(stream: DataFrame, digest: str, ts: str, remember: str = REMEMBER) -> DataFrame:
    """The first document of each digest within a time."""
    return stream.withWatermark(ts, remember).dropDuplicatesWithinWatermark([digest])


def statuses(stream: DataFrame, key: str = "document_id") -> DataFrame:
    """Status after each batch of events (kind: upload, start, done, fail): UPLOADED, PROCESSING, COMPLETED or FAILED; an
    upload after a failure begins anew, other events that do not fit are counted as ignored."""
    moves = {("", "upload"): "UPLOADED", ("UPLOADED", "start"): "PROCESSING", ("PROCESSING", "done"): "COMPLETED", ("PROCESSING", "fail"): "FAILED", ("FAILED", "upload"): "UPLOADED"}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n, ignored = state.get if state.exists else ("", 0, 0)
        events = pd.concat(frames).sort_values(["ts", "kind"], kind="stable")
        for kind in events["kind"]:
            after = moves.get((status, kind))
            status, n, ignored = (after, n + 1, ignored) if after else (status, n, ignored + 1)
        state.update((status, n, ignored))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "n_moves": [n], "n_ignored": [ignored]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, status string, n_moves long, n_ignored long", "status string, n long, ignored long", "update", GroupStateTimeout.NoTimeout)


def review_states(stream: DataFrame, item: str = "review_id") -> DataFrame:
    """The last state of each review item so far (update mode)."""
    return stream.groupBy(item).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n_events"))


def persisted(stream: DataFrame, path: str, checkpoint: str, key: str, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each batch replaces its keys' rows. A batch writes version N from version N - 1, so that a repeated batch gives the same."""

    def write(batch: DataFrame, number: int) -> None:
        new = process(batch)
        spark = batch.sparkSession
        if number:
            new = replaced(spark.read.parquet(f"{path}/v{number - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a folder of JSON lines until all that is there is written."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event time, as an extension: late rows count until the watermark has passed their window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by event time."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
