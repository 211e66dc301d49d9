"""Evidence and outcomes: hash-bound proof chains, current rows, outcomes per subject and role, invariants of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.nutrition import first_of
from granary.operators.relational import top1


def proof_chain(links: DataFrame, rows: DataFrame, run: str, following: str, proof: Sequence[str]) -> DataFrame:
    """Rows of one run that a linked run proves again: (run, following, proof columns...), equal in every proof column.

    ``links`` names pairs of runs; the rows join them on the run, then each other on the following run and all proof
    columns, content hash included, so that a changed row proves nothing. Nulls prove nothing.
    """
    once = rows.select(run, *proof).distinct()
    first = once.join(links, run)
    return first.join(once.withColumnRenamed(run, following), [following, *proof]).select(run, following, *proof)


def current_decision(decisions: DataFrame, keys: Sequence[str], authority: Column, decided: str, id_column: str, keep: Sequence[str]) -> DataFrame:
    """The decision in force per key: highest authority, then latest, then greatest id."""
    return top1(decisions, keys, [authority, F.col(decided), F.col(id_column)], [id_column, *keep])


def role_outcomes(requested: DataFrame, told: DataFrame, key: str, outcome: str, order: Sequence[str]) -> DataFrame:
    """(key, role, outcome) of every requested key and of every other key that something was told of.

    A requested key of which nothing was told has no_prediction; the best outcome of a key, by its place in
    ``order``, counts.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(outcome))
    best = told.groupBy(key).agg(F.min_by(outcome, place).alias("__best"))
    asked = requested.select(key).distinct().withColumn("__asked", F.lit(True))
    role = F.when(F.col("__asked"), "requested").otherwise("prediction")
    return asked.join(best, key, "full_outer").select(key, role.alias("role"), F.coalesce("__best", F.lit("no_prediction")).alias("outcome"))


def text_conflicts(rows: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """Keys with more than one distinct comparable text: min and max differ, so no set of texts is gathered."""
    return rows.withColumn("__t", text).groupBy(*keys).agg(F.count("__t").alias("texts"), (F.min("__t") != F.max("__t")).alias("conflict")).where(F.col("conflict"))


def first_seen_upsert(held: DataFrame, incoming: DataFrame, key: str, seen: str, keep: Sequence[str]) -> DataFrame:
    """Last write wins per key, by ``seen`` and then the kept columns, but the first time a key was seen stays: (key, first_seen, last_seen, kept columns...)."""
    both = held.unionByName(incoming)
    last = F.max(F.struct(seen, *keep))
    return both.groupBy(key).agg(F.min(seen).alias("first_seen"), last.alias("__l")).select(key, "first_seen", F.col(f"__l.{seen}").alias("last_seen"), *[F.col(f"__l.{c}").alias(c) for c in keep])


def broken_invariants(rows: DataFrame, key: str, invariants: dict[str, Column]) -> DataFrame:
    """(key, broken): the names of the invariants that don't hold, joined by commas, of the rows that break any."""
    names = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in invariants.items()]), lambda n: n.isNotNull())
    return rows.select(key, F.array_join(names, ",").alias("broken")).where(F.col("broken") != "")


def benchmark_errors(expected: DataFrame, actual: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float) -> DataFrame:
    """(keys..., errors): per expected row which fields are missing, unexpected or off by more than ``tolerance``; rows without errors are left out."""
    a = expected.select(*keys, *[F.col(f).alias(f"e_{f}") for f in fields])
    b = actual.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("__there"))

    def error(f: str) -> Column:
        e, t = F.col(f"e_{f}"), F.col(f"a_{f}")
        return first_of([(e.isNotNull() & t.isNull(), f"{f}_missing"), (e.isNull() & t.isNotNull(), f"{f}_unexpected"), (F.abs(e - t) > tolerance, f"{f}_differs")])

    errors = F.filter(F.array(F.when(F.col("__there").isNull(), F.lit("row_missing")), *[F.when(F.col("__there"), error(f)) for f in fields]), lambda x: x.isNotNull())
    return a.join(b, list(keys), "left").select(*keys, F.array_join(errors, ",").alias("errors")).where(F.col("errors") != "")


def priority_queue(items: DataFrame, order: Sequence[Column], partition: Sequence[str]) -> DataFrame:
    """Adds ``place``: each item's place in its partition's queue."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
