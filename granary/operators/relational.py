"""Relational building blocks: top rows per group, semi and anti joins, unanimity, set and partition checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import normalize_text, plain_text
from granary.session import cut_lineage


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row that is greatest by ``order`` per key, as an aggregate: one row per key and task is shuffled, not the group.

    ``order`` must decide all ties; its columns compare greatest-last with nulls lowest.
    """
    best = F.max(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("__row")))
    return df.groupBy(*keys).agg(best["__row"].alias("__row")).select(*keys, "__row.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key by ``order``, with their rank; Spark cuts each task's groups to n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which every term of the query stands in at least one of the columns; both are normalised."""
    terms = plain_text(query).split()
    texts = [normalize_text(F.col(c)) for c in columns]
    hits = [reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for text in texts]) for t in terms]
    return df.where(reduce(lambda a, b: a & b, hits, F.lit(True)))


def filtered(df: DataFrame, *, equal: dict[str, str] | None = None, states: dict[str, bool | None] | None = None, within: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """Rows that meet all of: equality per column; true, false or unknown (None) per boolean column; any of some words in a column's text."""
    for column, value in (equal or {}).items():
        df = df.where(F.col(column) == value)
    for column, state in (states or {}).items():
        df = df.where(F.col(column).isNull() if state is None else F.col(column) == state)
    for column, words in within:
        df = df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(column)), F.lit(w)) for w in words]))
    return df


def membership_join(left: DataFrame, key: str, right: DataFrame, values: Column) -> DataFrame:
    """Rows of both sides where ``key`` is one of the right side's ``values`` (an array), each pair once.

    The array is spelled out and met by equality, so there is no nested loop; nulls meet nothing.
    """
    each = right.withColumn("__value", F.explode(F.array_distinct(values)))
    return left.join(each, F.col(key) == F.col("__value")).drop("__value")


def uncontradicted(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows of keys whose rows agree in all fields, null being a value: an aggregate and a join on the key, no self-join by differences."""
    same = [F.min(f).eqNullSafe(F.max(f)) & ((F.count(f) == 0) | (F.count(f) == F.count("*"))) for f in fields]
    agreed = df.groupBy(*keys).agg(reduce(lambda a, b: a & b, same).alias("__same")).where("__same").select(*keys)
    return df.join(agreed, list(keys), "left_semi")


def bounded_details(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows per key with their rank, and whether the key has more (one row more is looked at)."""
    probe = top_n(df, keys, order, most + 1)
    more = F.max("rank").over(Window.partitionBy(*keys)) > most
    return probe.withColumn("truncated", more).where(F.col("rank") <= most)


def continuity(counts: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, most_drop: float) -> DataFrame:
    """Adds before, drop and accepted: whether ``value`` fell by at most ``most_drop`` of what it was one row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    drop = F.when(F.col("before") > 0, (F.col("before") - F.col(value)) / F.col("before"))
    return counts.withColumn("before", before).withColumn("drop", drop).withColumn("accepted", F.coalesce(F.col("drop") <= most_drop, F.lit(True)))


def unanimous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose rows all have one and the same non-null value, with it: min = max, no self-join and no distinct."""
    agg = df.groupBy(*keys).agg(F.min(value).alias("__min"), F.max(value).alias("__max"), F.count_if(F.col(value).isNull()).alias("__null"))
    return agg.where((F.col("__min") == F.col("__max")) & (F.col("__null") == 0)).select(*keys, F.col("__min").alias(value))


def set_difference_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys on each side, only left, only right, and whether the sets are equal. One full outer join."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(
        F.count("__l").alias("left_keys"),
        F.count("__r").alias("right_keys"),
        F.count_if(F.col("__r").isNull()).alias("only_left"),
        F.count_if(F.col("__l").isNull()).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def partition_check(requested: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Violations of an exact partition: keys missing from the outcomes, unexpected in them, or there more than once."""
    want = requested.groupBy(key).agg(F.count("*").alias("asked"))
    have = outcomes.groupBy(key).agg(F.count("*").alias("given"))
    kind = F.when(F.col("given").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when((F.col("asked") > 1) | (F.col("given") > 1), "duplicate")
    return want.join(have, key, "full_outer").withColumn("violation", kind).where(F.col("violation").isNotNull()).select(key, "violation")


def supersession_heads(ledger: DataFrame, id_column: str, supersedes: str) -> DataFrame:
    """Ledger rows that no other row supersedes."""
    return ledger.join(ledger.select(F.col(supersedes).alias(id_column)).where(F.col(id_column).isNotNull()), id_column, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows with ``kept``: true for the first of each key by ``order``. The order column must be unique."""
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    return df.alias("d").join(first.alias("f"), same).select("d.*", (F.col(f"d.{order}") == F.col("f.__first")).alias("kept"))


def prefix_candidates(left: DataFrame, right: DataFrame, block: str, name: str, left_id: str, right_id: str) -> DataFrame:
    """Pairs in one block whose names are equal (score 92) or of which one is a word prefix of the other (score 78).

    Each name is spelled out as its word prefixes and met by equality, so no block is compared pair by pair.
    """
    def prefixes(df: DataFrame, key: str, as_key: str) -> DataFrame:
        words = F.split(name, " ")
        each = F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " ")))
        return df.where((F.col(block) != "") & (F.col(name) != "")).select(F.col(key).alias(as_key), block, F.col(name).alias(f"__{as_key}"), each.alias("__prefix"))

    a, b = prefixes(left, left_id, "left_id"), prefixes(right, right_id, "right_id")
    longer = a.join(b.where(F.col("__right_id") == F.col("__prefix")), [block, "__prefix"])
    shorter = a.where(F.col("__left_id") == F.col("__prefix")).join(b.where(F.col("__right_id") != F.col("__prefix")), [block, "__prefix"])
    pairs = longer.unionByName(shorter).where(F.col("left_id") != F.col("right_id"))
    return pairs.select("left_id", "right_id", F.when(F.col("__left_id") == F.col("__right_id"), 92).otherwise(78).alias("score")).distinct()


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a total order, with the total and the number of pages; the rows are computed once for both."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("a page starts at 1 and has 1 to 100 rows")
    df = cut_lineage(df)
    total = df.agg(F.count("*").alias("total")).scalar()
    shown = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return shown.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def page_after(df: DataFrame, order: str, key: str, size: int, last: tuple | None = None) -> DataFrame:
    """The page after the row whose (order, key) is ``last``, the greatest order first: a filter and a top-n, however deep the page is."""
    if last is not None:
        df = df.where((F.col(order) < last[0]) | ((F.col(order) == last[0]) & (F.col(key) > last[1])))
    return df.orderBy(F.desc(order), key).limit(size)
