"""JSON and array helpers as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def canonical_json_hash(texts: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text with sorted keys, whole numbers without a fraction and no spaces; null if it isn't JSON."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        return int(value) if isinstance(value, float) and value.is_integer() else value

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
            return None if text is None else hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of the fields whose values differ, null being a value."""
    names = [F.when(~before[k].eqNullSafe(after[k]), F.lit(k)) for k in before]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def compact(fields: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def unknown_keys(text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed schema doesn't have."""
    return F.array_except(F.json_object_keys(text), F.array(*map(F.lit, allowed)))


def append(array: Column, value: Column) -> Column:
    return F.concat(F.coalesce(array, F.array().cast("array<string>")), F.array(value))
