"""Append-only decision ledgers: duplicates, conflicts, drift against current state, and accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nutrition import first_of


def dedupe_ledger(ledger: DataFrame, id_column: str, content: str) -> DataFrame:
    """(id, rows, state): one row per id; 'conflict' where repeats differ in content, else 'same'."""
    agg = ledger.groupBy(id_column).agg(F.count("*").alias("rows"), F.min(content).alias("__a"), F.max(content).alias("__b"), F.count_if(F.col(content).isNull()).alias("__n"))
    same = F.col("__a").eqNullSafe(F.col("__b")) & ((F.col("__n") == 0) | (F.col("__n") == F.col("rows")))
    return agg.select(id_column, "rows", F.when(same, "same").otherwise("conflict").alias("state"))


def ambiguous_keys(ledger: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Keys with more than one distinct id, and how many."""
    return ledger.groupBy(*keys).agg(F.countDistinct(id_column).alias("ids")).where(F.col("ids") > 1)


def drift(decisions: DataFrame, current: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], missing: str = "candidate_missing", unchanged: str = "exact") -> DataFrame:
    """Each decision's class against the current row of its key: the first of ``pairs`` (class: decision column, current column) that differs."""
    held = current.select(*keys, *{c for _, c in pairs.values()}, F.lit(True).alias("__there"))
    joined = decisions.join(held, keys, "left")
    rules: list[tuple[Column, str]] = [(F.col("__there").isNull(), missing)]
    rules += [(~F.col(a).eqNullSafe(F.col(b)), label) for label, (a, b) in pairs.items()]
    return joined.withColumn("classification", first_of(rules, unchanged)).drop("__there")


def outcome_summary(rows: DataFrame, keys: list[str], outcome: str, outcomes: list[str]) -> DataFrame:
    """Counts per key: all rows and each outcome."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])


def residual_bounds(summary: DataFrame, total: str, failed: str, most: int = 10, rate: float = 0.0025) -> DataFrame:
    """Adds ``accepted``: failures at most ``most`` and at most ``rate`` of the total."""
    share = F.coalesce(F.try_divide(F.col(failed), F.col(total)), F.lit(0.0))
    return summary.withColumn("failure_rate", share).withColumn("accepted", (F.col(failed) <= most) & (share <= rate))


def cross_conflict(rows: DataFrame, keys: list[str], fields: list[str], tolerance: float) -> DataFrame:
    """Keys with ``conflict``: some field's values differ by more than ``tolerance`` (relative to the larger, at least 1).

    For values of 0 or more the least and the greatest are the pair that differs most, so no self-join is needed.
    """
    spread = [F.coalesce((F.max(f) - F.min(f)) / F.greatest(F.max(f), F.lit(1.0)), F.lit(0.0)) for f in fields]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), (F.greatest(*spread, F.lit(0.0)) > tolerance).alias("conflict"))


def multiset_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows) where the two sides hold a key differently often."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    return a.join(b, key, "full_outer").fillna(0, ["left_rows", "right_rows"]).where(F.col("left_rows") != F.col("right_rows"))
