"""Model predictions of nutrition labels as candidates, their outcomes and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.nutrition import first_of, kcal_from
from granary.operators.ledgers import cross_conflict

# The nutrients of a candidate and the predicted codes that give them.
CODES = {
    "calories": ("energy-kcal", "energy-kj"), "protein": ("proteins",), "carbohydrate": ("carbohydrates",), "sugar": ("sugars",), "fat": ("fat",),
    "saturated_fat": ("saturated-fat",), "fibre": ("fiber", "fibre"), "sodium": ("sodium",),
}
_PREDICTED = "map<string,struct<value:string,unit:string,score:double>>"


def nutrition_candidates(predictions: DataFrame, keys: list[str], nutrients: str, confidence: float = 0.85) -> DataFrame:
    """One candidate per prediction from its JSON map of '<code>_<100g|serving>' to value, unit and score.

    Adds the nutrients (kcal, g, sodium in mg), basis, lowest score used, and reasons for rejection. Values below
    ``confidence`` don't count. Per 100 g is taken if it has energy and protein, else per serving; without both
    core values, or without energy above 0, a prediction is rejected.
    """
    made = predictions.withColumn("_map", F.from_json(F.col(nutrients), _PREDICTED))

    def said(code: str, basis: str) -> Column:
        cell = F.try_element_at(F.col("_map"), F.lit(f"{code}_{basis}"))
        value = F.replace(cell["value"], F.lit(","), F.lit(".")).try_cast("double")
        unit = F.lower(cell["unit"])
        if code.startswith("energy"):
            value = kcal_from(value, F.coalesce(unit, F.lit("kj" if code == "energy-kj" else "kcal")))
        if code == "sodium":
            value = F.when(unit == "mg", value).when(unit == "g", value * 1000)
        return F.when((cell["score"] >= confidence) & (value >= 0), F.struct(value.alias("value"), cell["score"].alias("score")))

    for basis in ("100g", "serving"):
        made = made.withColumns({f"_{name}_{basis}": F.coalesce(*[said(code, basis) for code in codes]) for name, codes in CODES.items()})
    whole = lambda b: (F.col(f"_calories_{b}.value") > 0) & F.col(f"_protein_{b}.value").isNotNull()
    basis = first_of([(whole("100g"), "per_100g"), (whole("serving"), "per_serving")])
    made = made.withColumn("basis", basis)
    pick = lambda name, part: F.when(F.col("basis") == "per_serving", F.col(f"_{name}_serving.{part}")).otherwise(F.col(f"_{name}_100g.{part}"))
    values = [F.when(F.col("basis").isNotNull(), pick(name, "value")).alias(name) for name in CODES]
    score = F.when(F.col("basis").isNotNull(), F.least(*[pick(name, "score") for name in CODES])).alias("score")
    reasons = F.filter(F.array(F.when(F.col("_map").isNull(), F.lit("unreadable_prediction")), F.when(F.col("_map").isNotNull() & F.col("basis").isNull(), F.lit("core_values_missing"))), lambda r: r.isNotNull())
    return made.select(*keys, *values, "basis", score, reasons.alias("reasons"))


def attempt_outcomes(requested: DataFrame, candidates: DataFrame, subject: str, tolerance: float = 0.15) -> DataFrame:
    """(subject, outcome, predictions, conflict) of every requested subject.

    candidate if any prediction was accepted, rejected if there were only others, no_prediction if there were none;
    conflict if accepted candidates differ in energy or protein by more than ``tolerance`` or in basis.
    """
    told = candidates.groupBy(subject).agg(F.count("*").alias("predictions"), F.count_if(F.size("reasons") == 0).alias("accepted"))
    good = candidates.where(F.size("reasons") == 0)
    clash = cross_conflict(good, [subject], ["calories", "protein"], tolerance).select(subject, F.col("conflict").alias("_values"))
    bases = good.groupBy(subject).agg((F.min("basis") != F.max("basis")).alias("_bases"))
    joined = requested.select(subject).distinct().join(told, subject, "left").join(clash, subject, "left").join(bases, subject, "left")
    outcome = first_of([(F.col("accepted") > 0, "candidate"), (F.col("predictions") > 0, "rejected")], "no_prediction")
    no = F.lit(False)
    return joined.select(subject, outcome.alias("outcome"), F.coalesce("predictions", F.lit(0)).alias("predictions"), (F.coalesce("_values", no) | F.coalesce("_bases", no)).alias("conflict"))
