"""Raw rows, predictions and label rows."""

import json

from pyspark.sql import functions as F

from granary.operators.ingest import normalize_source_rows
from granary.operators.label_rows import align_rows, row_value
from granary.operators.predictions import attempt_outcomes, nutrition_candidates


def test_normalize_source_rows(spark):
    schema = "code string, product_name string, brands string, quantity string, serving_size string, `energy-kcal_100g` string, `energy-kj_100g` string, proteins_100g string, sodium_100g string, countries_tags string, last_modified_t string, ingredients_text string, surplus string"
    data = [
        ("8900000000012", "Whey Protein", "Acme, Sub", "1 kg", "30 g", "400", None, "80", "0.2", "en:india", "86400", "milk (INS 322)", "x"),
        ("1", " ", None, "500 ml", "", "", "418.4", "bad", None, "en:france", "", None, None),
    ]
    a, b = sorted(normalize_source_rows(spark.createDataFrame(data, schema)).collect(), key=lambda r: r.source_record_id, reverse=True)
    assert (a.gtin, a.brand, a.category, a.net_grams, a.serving_grams, a.basis, a.sodium, a.in_slice, a.additives, a.observed_at) == ("08900000000012", "Acme", "protein_powder", 1000, 30, "per_100g", 200, True, "INS 322", "1970-01-02T00:00:00.000Z")
    assert a.marketed == ["protein", "whey"] and [i.code for i in a.issues] == []
    assert (b.gtin, b.name, b.net_grams, b.basis, b.protein, b.in_slice, b.observed_at) == (None, None, None, "per_100ml", None, False, "1970-01-01T00:00:00.000Z") and round(b.calories) == 100


def test_predictions(spark):
    def cell(value, unit="g", score=0.9):
        return {"value": value, "unit": unit, "score": score}

    full = {"energy-kj_100g": cell("418.4", "kJ"), "proteins_100g": cell("10,5"), "sodium_100g": cell("0.2"), "fat_100g": cell("3", score=0.5)}
    data = [
        ("a", 1, json.dumps(full)), ("a", 2, json.dumps({**full, "proteins_100g": cell("20")})), ("b", 3, json.dumps({"proteins_100g": cell("1")})), ("c", 4, "{"),
        ("d", 5, json.dumps({"energy-kcal_serving": cell("50", "kcal"), "proteins_serving": cell("5"), "proteins_100g": cell("9")})), ("f", 6, json.dumps(full)), ("f", 7, json.dumps(full)),
    ]
    made = nutrition_candidates(spark.createDataFrame(data, "subject string, prediction int, nutrients string"), ["subject", "prediction"], "nutrients")
    by = {r.prediction: r for r in made.collect()}
    assert (round(by[1].calories, 6), by[1].protein, by[1].sodium, by[1].fat, by[1].basis, by[1].score) == (100, 10.5, 200, None, "per_100g", 0.9)
    assert by[3].reasons == ["core_values_missing"] and by[3].protein is None and by[5].basis == "per_serving" and by[5].protein == 5
    requested = spark.createDataFrame([(s,) for s in "abcdef"], "subject string")
    outcomes = {r.subject: (r.outcome, r.predictions, r.conflict) for r in attempt_outcomes(requested, made, "subject").collect()}
    assert outcomes == {"a": ("candidate", 2, True), "b": ("rejected", 1, False), "c": ("rejected", 1, False), "d": ("candidate", 1, False), "e": ("no_prediction", 0, False), "f": ("candidate", 2, False)}


def test_label_rows(spark):
    lines = [("p", "24,5 g", 200.0, 101.0, 10.0, 10.0), ("p", "Protein", 10.0, 100.0, 10.0, 10.0), ("p", "Fat", 10.0, 140.0, 10.0, None), ("q", "x", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(lines, "id string, text string, x double, y double, width double, height double")
    found = align_rows(df, 12.0)
    assert sorted(map(tuple, found.collect())) == [("p", 0, "Protein 24,5 g"), ("p", 1, "Fat"), ("q", 0, "x")]
    values = [r.v for r in found.orderBy("id", "row").select(row_value(F.col("text")).alias("v")).collect()]
    assert values[0].asDict() == {"name": "protein", "value": 24.5, "unit": "g"} and values[1] is None
