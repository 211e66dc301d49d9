"""Observation times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CANONICAL = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def canonical_time(moment: Column) -> Column:
    """A timestamp as canonical ISO 8601 text in UTC with milliseconds (the session's zone must be UTC)."""
    return F.date_format(moment, _CANONICAL)


def observation_time(text: Column, epoch_seconds: Column) -> Column:
    """An ISO text, else epoch seconds above 0, else 1970."""
    by_epoch = F.when(epoch_seconds > 0, F.timestamp_seconds(epoch_seconds))
    return F.coalesce(text.try_cast("timestamp"), by_epoch, F.timestamp_seconds(F.lit(0)))


def is_canonical(text: Column) -> Column:
    return F.coalesce(canonical_time(text.try_cast("timestamp")) == text, F.lit(False))
