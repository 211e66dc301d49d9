"""Projections kept by precedence: the state after folding ordered rows into an incumbent, recomputed from all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.relational import top1


def upsert_total_order(incumbent: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both tables merged by a precedence that orders any two rows: the greatest row per key. Replaying changes nothing."""
    both = incumbent.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    return top1(both, keys, [F.col(o) for o in order], rest).select(*both.columns)


def fold_by_precedence(rows: DataFrame, key: str, sequence: Sequence[str], authority: str, observed: str, completeness: str, keep: Sequence[str]) -> DataFrame:
    """The row that survives when the rows of a key arrive in ``sequence`` order, which must decide all ties.

    A row replaces the one held if its authority is higher, or equal while it is later and not less complete. That
    isn't a total order, so rows are folded in sequence. Only rows of the key's highest authority can matter (the
    first of them replaces whatever is held), so the others are dropped first; the rest are sorted within their
    partition and streamed past one held row per key, so no task keeps a key's rows in memory.
    """
    needed = list(dict.fromkeys([key, *sequence, observed, completeness, *keep]))
    highest = rows.groupBy(key).agg(F.max(authority).alias("__top"))
    top = rows.join(highest, key).where(F.col(authority) == F.col("__top")).select(*needed)
    result = top.select(key, *keep)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict | None = None
        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                if held is None or held[key] != row[key]:
                    if held is not None:
                        done.append(held)
                    held = row
                elif row[observed] > held[observed] and row[completeness] >= held[completeness]:
                    held = row
            yield pd.DataFrame(done, columns=needed)[[key, *keep]]
        if held is not None:
            yield pd.DataFrame([held], columns=needed)[[key, *keep]]

    return top.repartition(F.col(key)).sortWithinPartitions(key, *sequence).mapInPandas(fold, result.schema)


def merge_columns(incumbent: DataFrame, incoming: DataFrame, key: str, policies: dict[str, str], gate: Column | None = None) -> DataFrame:
    """Per-column upsert: 'overwrite', 'keep' (old, else new), 'prefer' (new, else old), 'greatest'.

    ``gate`` (over o.* and n.*) decides whether an incoming row may change an old one at all.
    """
    both = incumbent.alias("o").join(incoming.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"o.{key}").isNull()
    may = F.col(f"n.{key}").isNotNull() & (fresh | (F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))))

    def value(column: str, policy: str) -> Column:
        old, new = F.col(f"o.{column}"), F.col(f"n.{column}")
        merged = {"overwrite": new, "keep": F.coalesce(old, new), "prefer": F.coalesce(new, old), "greatest": F.greatest(old, new)}[policy]
        return F.when(may, merged).otherwise(old).alias(column)

    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[value(c, p) for c, p in policies.items()])


def rehome(children: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Children of merged entities under their surviving entity: ``mapping`` is (old, new)."""
    joined = children.join(mapping.select(F.col("old").alias(column), F.col("new").alias("__new")), column, "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__new")


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each row and rule that doesn't hold; a rule that is null doesn't hold."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))
