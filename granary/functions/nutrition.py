"""Guarded ratios, nutrition rules and status logic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import normalize_text, parse_quantity


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def guarded_ratio(numerator: Column, denominator: Column, factor: float, missing: str) -> Column:
    """struct(value, reason): the ratio times ``factor``, or why there is none. Exactly one of the two is null."""
    lacks = numerator.isNull() | denominator.isNull()
    bad = ~_finite(numerator) | ~_finite(denominator) | (numerator < 0) | (denominator <= 0)
    reason = F.when(lacks, F.lit(missing)).when(bad, F.lit("invalid_input"))
    return F.struct(F.when(reason.isNull(), F.try_divide(numerator, denominator) * factor).alias("value"), reason.alias("reason"))


def protein_energy_conflict(calories: Column, protein: Column) -> Column:
    return F.coalesce((calories > 0) & (protein * 4 > calories), F.lit(False))


def unless(conflict: Column, reason: str, metric: Column) -> Column:
    return F.when(conflict, F.struct(F.lit(None).cast("double").alias("value"), F.lit(reason).alias("reason"))).otherwise(metric)


def nutrition_metrics(calories: Column, protein: Column, sugar: Column, saturated_fat: Column, fibre: Column, net_grams: Column, basis: Column) -> dict[str, Column]:
    """Derived metrics by name, each a struct(value, reason)."""
    conflict = protein_energy_conflict(calories, protein)
    guard = lambda m: unless(conflict, "protein_energy_exceeds_total", m)
    by_mass = basis == "per_100g"
    pack = F.when(by_mass & protein.isNotNull() & (net_grams > 0), net_grams * protein / 100)
    lacks = F.when(by_mass, F.lit("missing_protein_or_pack_weight")).otherwise(F.lit("nutrition_basis_not_mass_normalized"))
    return {
        "protein_per_100_kcal": guard(guarded_ratio(protein, calories, 100.0, "missing_protein_or_calories")),
        "protein_energy_percent": guard(guarded_ratio(protein * 4, calories, 100.0, "missing_protein_or_calories")),
        "kcal_per_25g_protein": guard(guarded_ratio(calories, protein, 25.0, "missing_protein_or_calories")),
        "sugar_per_25g_protein": guarded_ratio(sugar, protein, 25.0, "missing_sugar_or_protein"),
        "saturated_fat_per_25g_protein": guarded_ratio(saturated_fat, protein, 25.0, "missing_saturated_fat_or_protein"),
        "fibre_per_100_kcal": guarded_ratio(fibre, calories, 100.0, "missing_fibre_or_calories"),
        "protein_in_pack": F.struct(pack.alias("value"), F.when(pack.isNull(), lacks).alias("reason")),
    }


def issue(condition: Column, code: str, field: str, severity: str | Column = "error") -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), level.alias("severity"), F.lit(field).alias("field")))


def validation_issues(values: dict[str, Column], basis: Column, net_grams: Column | None = None, serving_grams: Column | None = None) -> Column:
    """The codes and limits of each rule. Array of struct(code, severity, field) over calories, protein, carbohydrate, sugar, fat, saturated_fat, fibre and sodium."""
    none = F.lit(None).cast("double")
    kcal, p, c, s, f, sat = (values.get(k, none) for k in ("calories", "protein", "carbohydrate", "sugar", "fat", "saturated_fat"))
    grams = [k for k in ("protein", "carbohydrate", "sugar", "fat", "saturated_fat", "fibre") if k in values]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    off = F.abs(4 * p + 4 * c + 9 * f - kcal)
    mismatch = F.when(kcal == 0, F.when(off > 0, F.lit(float("inf")))).otherwise(F.try_divide(off, kcal))
    rules = [
        *[issue(~_finite(v) | (v < 0), "invalid_numeric_value", k) for k, v in values.items()],
        *[issue(values[k] > 100, "nutrient_over_100g", k) for k in grams],
        issue(kcal <= 0, "non_positive_energy", "calories"),
        issue((basis == "per_100g") & (kcal > 900), "energy_over_physical_maximum", "calories"),
        issue((kcal > 0) & (4 * p > 1.1 * kcal), "protein_energy_exceeds_total", "protein"),
        issue((kcal > 0) & (4 * zero(p) + 9 * zero(f) > 1.1 * kcal), "macro_energy_exceeds_total", "calories"),
        issue(sat > f, "saturated_fat_exceeds_fat", "saturated_fat"),
        issue(s > c, "sugar_exceeds_carbohydrate", "sugar"),
        issue((basis == "per_100g") & (zero(p) + zero(c) + zero(f) > 110), "macro_total_impossible", "protein"),
        issue(mismatch > 0.25, "calorie_macro_mismatch", "calories", F.when(mismatch > 0.5, F.lit("error")).otherwise(F.lit("warning"))),
    ]
    if net_grams is not None and serving_grams is not None:
        rules.append(issue(serving_grams > net_grams, "serving_exceeds_pack", "serving_size"))
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def completeness(fields: dict[str, Column]) -> Column:
    """struct(score, missing): the rounded percentage of fields that are neither null nor empty, and the others' names."""
    lacks = {k: v.isNull() | (v.cast("string") == "") for k, v in fields.items()}
    missing = F.filter(F.array(*[F.when(F.coalesce(m, F.lit(True)), F.lit(k)) for k, m in lacks.items()]), lambda k: k.isNotNull())
    return F.struct(F.round((len(fields) - F.size(missing)) * 100.0 / len(fields)).cast("int").alias("score"), missing.alias("missing"))


def per_100(value: Column, serving: Column) -> Column:
    return F.when(serving > 0, value * 100 / serving)


def kcal_from(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit) == "kj", value / 4.184).otherwise(value)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def corrected_energy(raw: Column, protein: Column, carbohydrate: Column, fat: Column) -> Column:
    """kcal of a value labelled kJ: the value itself if only that is plausible beside the macronutrients, else converted."""
    floor = (protein + carbohydrate) * 4 + F.coalesce(fat, F.lit(0.0)) * 9
    mislabelled = (raw / 4.184 < floor * 0.85) & (raw <= 1000) & raw.between(floor * 0.85, floor * 1.5)
    return F.when(F.coalesce(mislabelled, F.lit(False)), raw).otherwise(raw / 4.184)


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


# Words that market a product for its protein.
MARKETED_TERMS = ("protein", "high protein", "whey", "casein", "protein bar", "protein chips", "protein cereal", "protein shake", "protein yogurt")


def marketed_reasons(normalised: Column) -> Column:
    return F.filter(F.array(*map(F.lit, MARKETED_TERMS)), lambda t: F.contains(normalised, t))


def density_reasons(calories: Column, protein: Column, serving_grams: Column, basis: Column) -> Column:
    """Names of the density conditions that hold."""
    fair = (calories > 0) & ~protein_energy_conflict(calories, protein)
    rules = [
        F.when(F.coalesce(fair & (protein * 100 >= 10 * calories), F.lit(False)), F.lit("protein_at_least_10g_per_100kcal")),
        F.when(F.coalesce(fair & (protein * 400 >= 20 * calories), F.lit(False)), F.lit("protein_at_least_20_percent_calories")),
        F.when(F.coalesce((basis == "per_100g") & (protein * serving_grams / 100 >= 10), F.lit(False)), F.lit("protein_at_least_10g_per_serving")),
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def dense(calories: Column, protein: Column, reasons: Column, verified: Column) -> Column:
    """True, false, or null if what is verified isn't enough to tell."""
    enough = calories.isNotNull() & protein.isNotNull() & ~protein_energy_conflict(calories, protein)
    return F.when(verified, F.when(F.size(reasons) > 0, F.lit(True)).when(enough, F.lit(False)))


def next_status(current: Column, incoming_verified: Column, conflicts: Column) -> Column:
    return (
        F.when(conflicts & ((current == "verified") | incoming_verified), F.lit("conflict"))
        .when(incoming_verified, F.lit("verified"))
        .when(current == "missing", F.lit("unverified"))
        .otherwise(current)
    )


def basis_of(declared: Column, unit: Column, *texts: Column) -> Column:
    """per_100ml or per_100g from a declaration, a unit, or the first text that prints a metric quantity; per_100g else."""
    said, written = normalize_text(declared), normalize_text(unit)
    chain = (
        F.when(said.isin("100ml", "per 100ml", "per 100 ml", "100 ml"), F.lit("per_100ml"))
        .when(said.isin("100g", "per 100g", "per 100 g", "100 g"), F.lit("per_100g"))
        .when(written.isin("ml", "cl", "dl", "l", "millilitre", "milliliter", "litre", "liter"), F.lit("per_100ml"))
        .when(written.isin("g", "kg", "gram", "grams", "kilogram", "kilograms"), F.lit("per_100g"))
    )
    for text in texts:
        quantity = parse_quantity(text)
        chain = chain.when(quantity["millilitres"].isNotNull(), F.lit("per_100ml")).when(quantity["grams"].isNotNull(), F.lit("per_100g"))
    return chain.otherwise(F.lit("per_100g"))


def serving_evidence(value: Column, text_value: Column, pack: Column, tolerance: float = 0.02) -> Column:
    """struct(grams, state): a serving size from a number and a printed size: corroborated, single, conflict or implausible."""
    agree = relative_difference(value, text_value) <= tolerance
    grams = F.when(value.isNotNull() & text_value.isNotNull(), F.when(agree, value)).otherwise(F.coalesce(value, text_value))
    fits = pack.isNull() | (grams <= pack)
    state = (
        F.when(value.isNull() & text_value.isNull(), F.lit("missing"))
        .when(value.isNotNull() & text_value.isNotNull() & ~agree, F.lit("conflict"))
        .when(~(fits & (grams > 0)), F.lit("implausible"))
        .when(value.isNotNull() & text_value.isNotNull(), F.lit("corroborated"))
        .otherwise(F.lit("single"))
    )
    return F.struct(F.when(state.isin("single", "corroborated"), grams).alias("grams"), state.alias("state"))


def first_of(pairs: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds: ordered classification."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, label in pairs:
        chain = chain.when(F.coalesce(condition, F.lit(False)), F.lit(label))
    return chain.otherwise(F.lit(otherwise))
