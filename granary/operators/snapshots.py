"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import broadcast_if_small

_SPACE = "[\\s\u00a0\u200b\ufeff]+"


def canonical_key(key: Column) -> Column:
    """The key trimmed; digits only become 14 digits, leading zeros beyond those dropped."""
    trimmed = F.regexp_replace(key, f"^{_SPACE}|{_SPACE}$", "")
    digits = F.regexp_replace(trimmed, "^0+", "")
    padded = F.when(F.length(digits) < 14, F.lpad(digits, 14, "0")).otherwise(digits)
    return F.when(trimmed.rlike(r"^[0-9]+$"), padded).otherwise(trimmed)


def canonical_hash(value: Column) -> Column:
    """A hash in lower case, without white space and an algorithm's name before it."""
    bare = F.lower(F.regexp_replace(value, _SPACE, ""))
    return F.regexp_replace(bare, r"^(0x|sha-?\d+[:=\-])", "")


def snapshot_changes(
    rows: DataFrame,
    runs: DataFrame,
    *,
    run: str = "run_id",
    key: str = "source_record_id",
    content: str = "content_hash",
    loaded: str = "loaded_at",
    source: str = "source_id",
    started: str = "started_at",
    complete: str = "source_complete",
    max_runs: int = 50_000,
) -> DataFrame:
    """Records added, removed or changed in each complete run against the complete run before it of its source.

    Every complete run gets an ordinal within its source. The rows of ordinal n are joined with those of ordinal
    n - 1 in one full outer join on (source, ordinal, key) that compares canonical hashes, so all pairs of runs of
    all sources are compared at once, and no task holds more than its share of keys.

    Defined cases: a run belongs to the source that the run table names; a null or blank key is no record; a null
    hash equals only a null hash; of several rows for one key in a run the last loaded counts (ties: the greatest
    hash); rows of unknown or incomplete runs are passed over; runs without a start come first, ties by run id; a
    complete run without rows removes all; other columns are ignored; empty inputs give no rows.

    Returns run_id, source_record_id, change_kind.
    """
    order = Window.partitionBy("src").orderBy(F.col("began").asc_nulls_first(), "run_id")
    known = (
        runs.where(F.col(complete) & F.col(run).isNotNull())
        .select(F.col(run).alias("run_id"), F.col(source).alias("src"), F.col(started).alias("began"))
        .groupBy("run_id")
        .agg(F.max("src").alias("src"), F.min("began").alias("began"))
        .where(F.col("src").isNotNull())
        .select("run_id", "src", F.row_number().over(order).alias("nth"))
    )
    known = broadcast_if_small(known, max_runs)
    held = (
        rows.select(
            F.col(run).alias("run_id"),
            canonical_key(F.col(key)).alias("rec"),
            canonical_hash(F.col(content)).alias("hash"),
            F.col(loaded).alias("loaded"),
        )
        .where(F.col("rec") != "")
        .join(known, "run_id")
        .groupBy("src", "nth", "rec")
        .agg(F.max(F.struct("loaded", "hash"))["hash"].alias("hash"))
    )
    now = held.select("src", "nth", "rec", F.col("hash").alias("hash_now"), F.lit(True).alias("is_now"))
    then = held.select("src", (F.col("nth") + 1).alias("nth"), "rec", F.col("hash").alias("hash_then"), F.lit(True).alias("was_then"))
    kind = (
        F.when(F.col("was_then").isNull(), "added")
        .when(F.col("is_now").isNull(), "removed")
        .when(~F.col("hash_now").eqNullSafe(F.col("hash_then")), "changed")
    )
    return (
        now.join(then, ["src", "nth", "rec"], "full_outer")
        .withColumn("change_kind", kind)
        .where((F.col("nth") > 1) & F.col("change_kind").isNotNull())
        .join(known, ["src", "nth"])
        .select("run_id", F.col("rec").alias("source_record_id"), "change_kind")
    )
