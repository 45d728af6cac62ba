"""Structured Streaming extensions: event-time windows and sessions with watermarks, and known values beside a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: str, value: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, length, slide) if slide else F.window(time, length), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, for idempotent intake."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def known_beside(stream: DataFrame, history: DataFrame, key: str, time: str, valid_from: str, valid_to: str, payload: list[str]) -> DataFrame:
    """A stream joined to the state that was valid at each event's time, from a static history of half-open spans. A null end is open."""
    h = history.select(F.col(key).alias("__k"), F.col(valid_from).alias("__a"), F.col(valid_to).alias("__b"), *[F.col(c).alias(f"known_{c}") for c in payload])
    inside = (F.col(key) == F.col("__k")) & (F.col(time) >= F.col("__a")) & (F.col("__b").isNull() | (F.col(time) < F.col("__b")))
    return stream.join(h, inside, "left").drop("__k", "__a", "__b")


def spans(changes: DataFrame, key: str, time: str, payload: list[str]) -> DataFrame:
    """(key, valid_from, valid_to, payload) from changes in time; of changes at one time the largest payload counts."""
    one = changes.dropna(subset=[key, time]).groupBy(key, time).agg(F.max(F.struct(*payload)).alias("p"))
    return one.select(key, F.col(time).alias("valid_from"), F.lead(time).over(Window.partitionBy(key).orderBy(time)).alias("valid_to"), *[F.col(f"p.{c}").alias(c) for c in payload])


def resumable(stream: DataFrame, out: str, checkpoint: str, key: str):
    """A started query that appends new keys to `out`; after a failure it goes on where the checkpoint says, and a repeated batch adds nothing."""
    from chronotext.sources.writers import append_missing

    def write(batch: DataFrame, _: int) -> None:
        append_missing(batch.sparkSession, batch.dropDuplicates([key]), out, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
