"""One surviving record per group of duplicates, field by field, and truth discovery over the same claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import broadcast_if_small, cut_lineage

TEXT_FIELDS = ("brand", "item_name", "flavour", "ingredients_raw")
NUMBER_FIELDS = ("net_quantity_grams", "serving_size_grams", "calories", "protein_grams")
FIELDS = ("brand", "item_name", "flavour", "net_quantity_grams", "serving_size_grams", "ingredients_raw", "calories", "protein_grams")
_SPACE = "[\\s ​﻿]+"
# Stand-ins for a value that isn't known.
NOT_KNOWN = (
    "", "-", "--", "---", "–", "—", ".", "?", "n/a", "n.a.", "n.a", "na", "nil", "none", "null", "nan", "unknown", "not known", "not available",
    "not applicable", "not specified", "unspecified", "not stated", "tbd", "tba", "to be determined", "to be announced", "undefined", "missing", "#n/a",
)


def tidy(text: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(text, _SPACE, " ")))


def usable(field: str, column: Column) -> Column:
    """Whether a field says something: not null, blank or a stand-in; a number neither NaN nor negative."""
    if field in NUMBER_FIELDS:
        return F.coalesce(~F.isnan(column.cast("double")) & (column.cast("double") >= 0), F.lit(False))
    return F.coalesce(~tidy(column.cast("string")).isin(*NOT_KNOWN), F.lit(False))


def observed_time(text: Column) -> Column:
    """A moment from ISO 8601 with or without a zone (then UTC), or from epoch seconds or milliseconds; null if neither."""
    bare = F.trim(F.regexp_replace(text, _SPACE, " "))
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.when(bare.rlike(r"(?i)(z|utc|[+-]\d{2}:?\d{2})$"), bare).otherwise(F.concat(bare, F.when(F.length(bare) <= 10, F.lit("T00:00:00Z")).otherwise(F.lit("Z")))))
    seconds = F.when(bare.rlike(r"^\d{1,11}(\.\d+)?$"), bare.try_cast("double")).when(bare.rlike(r"^\d{12,14}$"), bare.try_cast("double") / 1000)
    return F.coalesce(F.timestamp_seconds(seconds), iso.try_cast("timestamp"))


def _with_authority(records: DataFrame, sources: DataFrame, source: str, authority: str) -> DataFrame:
    known = sources.select(tidy(F.col(source)).alias("src"), F.col(authority).alias("authority")).where(F.col("src").isNotNull()).groupBy("src").agg(F.max("authority").alias("authority"))
    return records.join(broadcast_if_small(known), "src", "left").withColumn("authority", F.coalesce("authority", F.lit(0)))


def surviving_values(
    records: DataFrame,
    sources: DataFrame,
    *,
    group: str = "product_id",
    record: str = "record_id",
    source: str = "source_id",
    observed: str = "evidence_observed_at",
    status: str = "nutrition_status",
    authority: str = "nutrition_authority",
    fields: tuple[str, ...] = FIELDS,
) -> DataFrame:
    """For each group of two or more records the surviving record, and per field the record that supplies the value.

    A record is better by: verified status; authority of its source; later observed; more usable fields; smaller
    id. One aggregation per group takes the best record of all and of those usable per field, so a task keeps one
    candidate per group and field however many records the group has, and only these are shuffled.

    Defined cases: sources and statuses are compared without case and outer white space; an unknown or null source
    has authority 0; a time that can't be read, or none, is the earliest; a field that no record has gives no row;
    rows delivered again count once; null group or record ids give no row; other columns are ignored.

    Returns product_id, field_name, record_id.
    """
    plain = records.select(
        F.col(group).alias("g"), F.col(record).alias("r"), tidy(F.col(source)).alias("src"), observed_time(F.col(observed)).alias("at"),
        F.coalesce(tidy(F.col(status)) == "verified", F.lit(False)).alias("verified"), *[usable(f, F.col(f)).alias(f"u_{i}") for i, f in enumerate(fields)],
    ).where(F.col("g").isNotNull() & F.col("r").isNotNull())
    flags = [F.col(f"u_{i}") for i in range(len(fields))]
    ranked = _with_authority(plain, sources, source, authority).withColumn("filled", sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")))
    rank = F.struct("verified", "authority", "at", "filled", (-F.col("r")).alias("back"), "r")
    best = ranked.groupBy("g").agg(
        F.min("r").alias("least"),
        F.max("r").alias("most"),
        F.max(rank)["r"].alias("record"),
        *[F.max(F.when(flag, rank))["r"].alias(f"b_{i}") for i, flag in enumerate(flags)],
    )
    rows = F.array(F.struct(F.lit("record").alias("field_name"), F.col("record").alias("record_id")), *[F.struct(F.lit(f).alias("field_name"), F.col(f"b_{i}").alias("record_id")) for i, f in enumerate(fields)])
    return best.where(F.col("least") < F.col("most")).select(F.col("g").alias("product_id"), F.inline(rows)).where(F.col("record_id").isNotNull())


def claims_of(records: DataFrame, *, group: str = "product_id", record: str = "record_id", source: str = "source_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per group, field, source and distinct usable value: what a source claims, however often it says so."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(usable(f, F.col(f)), tidy(F.col(f).cast("string"))).alias("value")) for f in fields]))
    said = records.where(F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(group).alias("g"), F.col(record).alias("r"), F.coalesce(tidy(F.col(source)), F.lit("")).alias("src"), each.alias("c"))
    return said.where(F.col("c.value").isNotNull()).groupBy("g", F.col("c.field").alias("field"), "src", F.col("c.value").alias("value")).agg(F.min("r").alias("r"))


_FEW_SOURCES = 1_000


def _support(values: DataFrame, trust: DataFrame) -> DataFrame:
    """Adds support, the summed log odds of the reliabilities of a value's sources."""
    odds = F.log(F.col("reliability") / (1 - F.col("reliability")))
    weights = trust.select("src", odds.alias("odds"))
    few = weights.limit(_FEW_SOURCES + 1).collect()
    if len(few) <= _FEW_SOURCES:  # a small map goes along with the expression: no join and no shuffle
        by_source = F.create_map(*[x for r in few for x in (F.lit(r.src), F.lit(r.odds))]) if few else F.create_map().cast("map<string,double>")
        return values.withColumn("support", F.aggregate("sources", F.lit(0.0), lambda total, s: total + F.coalesce(F.element_at(by_source, s), F.lit(0.0))))
    said = values.select("g", "field", "value", F.explode("sources").alias("src")).join(weights, "src").groupBy("g", "field", "value").agg(F.sum("odds").alias("support"))
    return values.join(said, ["g", "field", "value"])


def discover_truth(claims: DataFrame, *, start: float = 0.8, tolerance: float = 1e-3, max_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Iterative truth discovery over (g, field, src, value, r): the best supported values, and each source's reliability.

    In turn, each value gets the summed log odds of its sources' reliabilities, the highest is taken per group and
    field (ties: the value whose first record is smallest), and a source's reliability becomes the smoothed share
    of its claims that were taken. Ends when no reliability moves by more than ``tolerance``; ``settled`` of the
    reliabilities is false if ``max_rounds`` passed before.

    Claims are gathered once into one row per value with its sources. A round is then a map over these rows, an
    aggregate that keeps one value per group and field and task before it shuffles, and a count per source of the
    taken values' own sources: nothing is joined back to the claims. A group's values are never gathered.
    """
    values = cut_lineage(claims.groupBy("g", "field", "value").agg(F.min("r").alias("r"), F.collect_set("src").alias("sources")))
    claimed = cut_lineage(values.select(F.explode("sources").alias("src")).groupBy("src").agg(F.count("*").alias("claims")))
    trust = claimed.select("src", F.lit(start).alias("reliability"))
    settled = False
    for _ in range(max_rounds):
        top = F.max(F.struct(F.round("support", 9).alias("support"), (-F.col("r")).alias("back"), "value", "r", "sources"))
        truth = cut_lineage(_support(values, trust).groupBy("g", "field").agg(top.alias("t")).select("g", "field", "t.value", "t.support", "t.r", "t.sources"))
        taken = truth.select(F.explode("sources").alias("src")).groupBy("src").agg(F.count("*").alias("taken"))
        share = (F.coalesce("taken", F.lit(0)) + 8 * start) / (F.col("claims") + 8)
        renewed = claimed.join(taken, "src", "left").select("src", F.least(F.greatest(share, F.lit(0.01)), F.lit(0.99)).alias("renewed"))
        both = cut_lineage(renewed.join(trust, "src"))
        trust = both.select("src", F.col("renewed").alias("reliability"))
        moved = both.agg(F.max(F.abs(F.col("renewed") - F.col("reliability"))).alias("m")).first()["m"]
        if moved is None or moved <= tolerance:
            settled = True
            break
    return truth.drop("sources"), trust.withColumn("settled", F.lit(settled))
