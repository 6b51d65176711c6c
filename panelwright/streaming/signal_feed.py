"""The signal log as a stream sink: new signal rows are appended once, however often a batch is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import log_rows


def append_signal_stream(signals: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Streaming form of ``append_signal`` (S11): Parquet file sink, exactly once by its commit log."""
    writer = log_rows(signals).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
