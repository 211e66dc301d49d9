"""Raw source rows normalised into staged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import nutrition as nu
from granary.functions import text as tx
from granary.functions.times import canonical_time, observation_time

# Staged nutrients and the raw columns that hold them per 100 g or ml.
NUTRIENTS = {
    "calories": "energy-kcal_100g", "protein": "proteins_100g", "carbohydrate": "carbohydrates_100g", "sugar": "sugars_100g", "fat": "fat_100g",
    "saturated_fat": "saturated-fat_100g", "fibre": "fiber_100g", "sodium": "sodium_100g",
}


def mass_of(text: Column, number: Column, unit: Column, bare_is_grams: bool = False) -> Column:
    """Grams from a printed quantity, else from a number with a unit of mass; a printed volume has none."""
    printed = tx.parse_quantity(text)
    written = tx.normalize_text(unit)
    grams = F.when(number > 0, F.when(written.isin("g", "gram", "grams"), number).when(written.isin("kg", "kilogram", "kilograms"), number * 1000))
    if bare_is_grams:
        grams = F.coalesce(grams, F.when((number > 0) & (written == ""), number))
    return F.when(printed.isNotNull(), printed["grams"]).otherwise(grams)


def normalize_source_rows(raw: DataFrame) -> DataFrame:
    """Staged records from raw rows of strings: identity, quantities, nutrition with its issues, classification, time.

    Missing raw columns count as empty. Rejections and duplicates are left to ``granary.sources.files.stage``.
    """
    have = set(raw.columns)
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c in have else F.lit(None).cast("string")
    number = lambda c: text(c).try_cast("double")
    basis = nu.basis_of(text("nutrition_data_per"), text("product_quantity_unit"), text("quantity"), text("serving_size"))
    values = {k: number(c) * (1000 if k == "sodium" else 1) for k, c in NUTRIENTS.items()}
    values["calories"] = F.coalesce(values["calories"], number("energy-kj_100g") / 4.184)
    staged = raw.select(
        text("code").alias("source_record_id"),
        tx.gtin14(text("code")).alias("gtin"),
        F.split_part(F.coalesce(text("brands"), F.lit("")), F.lit(","), F.lit(1)).alias("brand"),
        F.coalesce(text("product_name"), text("generic_name")).alias("name"),
        tx.category_of(text("categories"), text("categories_tags"), text("product_name")).alias("category"),
        mass_of(text("quantity"), number("product_quantity"), text("product_quantity_unit"), True).alias("net_grams"),
        mass_of(text("serving_size"), number("serving_quantity"), text("serving_quantity_unit")).alias("serving_grams"),
        basis.alias("basis"),
        *[v.alias(k) for k, v in values.items()],
        text("ingredients_text").alias("ingredients"),
        F.array_join(tx.additive_codes(text("ingredients_text"), F.split(text("additives_tags"), ",")), ",").alias("additives"),
        tx.in_country(text("countries_tags"), F.concat_ws(" ", text("countries"), text("countries_en")), "india").alias("in_slice"),
        canonical_time(observation_time(text("last_modified_datetime"), number("last_modified_t"))).alias("observed_at"),
        tx.normalize_text(F.concat_ws(" ", text("brands"), text("product_name"), text("labels"))).alias("_marketing"),
    )
    issues = nu.validation_issues({k: F.col(k) for k in NUTRIENTS if k != "sodium"}, F.col("basis"), F.col("net_grams"), F.col("serving_grams"))
    marketed = nu.marketed_reasons(F.col("_marketing"))
    return staged.withColumn("issues", issues).withColumn("marketed", marketed).drop("_marketing")
