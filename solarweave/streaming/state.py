"""Streaming forms: last known status of each model, latest request of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_known_stream(events: DataFrame, key: str, time: str, value: str, late: str = "1 hour") -> DataFrame:
    """Running (key, known): the value that isn't null with the latest time. Use output mode complete or update.

    State is one row a key. Rows later than the watermark are dropped by Spark.
    """
    real = events.withWatermark(time, late).filter(F.col(value).isNotNull())
    return real.groupBy(key).agg(F.max_by(value, time).alias("known"), F.max(time).alias("at"))


def latest_request_stream(events: DataFrame, session: str, seq: str, payload: str) -> DataFrame:
    """Running (session, payload, seq) of the highest sequence number: older answers are discarded."""
    return events.groupBy(session).agg(F.max_by(payload, seq).alias(payload), F.max(seq).alias(seq))
