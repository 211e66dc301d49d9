"""Exact entity resolution: a valid GTIN first, then the composite of brand, name, flavour and size, else new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import composite_key, gtin14


def keyed(df: DataFrame, id_column: str, gtin: str, brand: str, name: str, flavour: str, grams: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), gtin14(F.col(gtin)).alias("gtin"), composite_key(F.col(brand), F.col(name), F.col(flavour), F.col(grams)).alias("composite"))


def resolve_entities(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, match_id, outcome) for each incoming row of ``keyed`` columns.

    outcome is exact_gtin, duplicate_canonical_gtin, exact_composite, ambiguous_exact_composite, no_exact_match or
    insufficient_exact_identity. Candidates are counted per key before they are joined, so an ambiguous key never
    fans out.
    """
    def per_key(key: str) -> DataFrame:
        return candidates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(f"{key}_id"), F.count("*").alias(f"{key}_n"))

    joined = incoming.join(per_key("gtin"), "gtin", "left").join(per_key("composite"), "composite", "left")
    outcome = (
        F.when(F.col("gtin_n") == 1, "exact_gtin")
        .when(F.col("gtin_n") > 1, "duplicate_canonical_gtin")
        .when(F.col("composite").isNull(), "insufficient_exact_identity")
        .when(F.col("composite_n") == 1, "exact_composite")
        .when(F.col("composite_n") > 1, "ambiguous_exact_composite")
        .otherwise("no_exact_match")
    )
    match = F.when(F.col("outcome") == "exact_gtin", F.col("gtin_id")).when(F.col("outcome") == "exact_composite", F.col("composite_id"))
    return joined.withColumn("outcome", outcome).select("id", match.alias("match_id"), "outcome")
