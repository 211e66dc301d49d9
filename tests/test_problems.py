"""The operators of the general problems: small cases, awkward inputs and brute force."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.operators.packed import _pieces, cut_deep, nesting, resolve_skeleton, unpack_fields
from granary.operators.shred import EACH, elements, flatten_payloads, parse_whole, shred, values, whole_number
from granary.operators.snapshots import snapshot_changes
from granary.operators.units import common_amounts, observations, pairwise_scales, propagate, seeds

T = datetime(2026, 1, 1)
LABEL = "label_id long, ingredients_raw string, contains_raw string, traces_raw string, observed_at timestamp"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- packed fields -------------------------------------------------------------------------------------------------


def unpacked(spark, text, field="ingredients_raw"):
    cells = {"ingredients_raw": None, "contains_raw": None, "traces_raw": None, field: text}
    df = spark.createDataFrame([(1, *cells.values(), T)], LABEL)
    found = unpack_fields(df).collect()
    assert {r.field_name for r in found} <= {field}
    assert sorted(r.pos for r in found) == list(range(len(found)))
    return [r.item_text for r in sorted(found, key=lambda r: r.pos)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("milk, egg; soy", ["milk", "egg", "soy"]),
        ("a (b, c [d; e]), f 4,3 %", ["a (b, c [d; e])", "f 4,3 %"]),
        ('["Nuts, mixed", "Fish"]', ["Nuts, mixed", "Fish"]),
        ('"oats, whole grain";"""house"" mix"', ["oats, whole grain", '"house" mix']),
        ("Ingredients: 1. salt\n2. oats.", ["salt", "oats"]),
        ("(1) inulin (2) dates (3%)", ["inulin", "dates (3%)"]),
        ("• a • b", ["a", "b"]),
        ("a / b/c /", ["a", "b/c"]),
        ("a;; b, , c，d、e；", ["a", "b", "c", "d", "e"]),
        ("a<br/>b<BR>c|d\te", ["a", "b", "c", "d", "e"]),
        ("natural and artificial flavours & salt", ["natural and artificial flavours", "salt"]),
        ("N/A", []),
        ("  ", []),
        ("-", []),
        (None, []),
    ],
)
def test_unpack(spark, text, want):
    assert unpacked(spark, text) == want


def test_and_joins_values_of_allergen_fields_only(spark):
    assert unpacked(spark, "Contains: egg, milk and soy", "contains_raw") == ["egg", "milk", "soy"]
    assert unpacked(spark, 'May contain "bread and butter" and egg.', "traces_raw") == ["bread and butter", "egg"]


def test_unpack_long_and_unbalanced_texts(spark):
    assert len(unpacked(spark, "milk, " * 20_000)) == 20_000
    assert unpacked(spark, "(" + "(a, b), " * 5_000 + "), c")[-1] == "c"
    assert unpacked(spark, "[" * 3_000) == ["[" * 3_000]
    assert unpacked(spark, "x (y, z") == ["x (y", "z"]


def test_unpack_rare_skeletons_join_without_broadcast(spark, folder):
    labels = spark.read.parquet(f"{folder}/label_products.parquet")
    assert rows(unpack_fields(labels, max_broadcast=3)) == rows(unpack_fields(labels))


def test_unpack_repeats_empties_and_foreign_columns(spark):
    df = spark.createDataFrame([(1, "a, b", None, None, T)] * 2 + [(None, "x", None, None, T)], LABEL)
    extra = df.withColumn("pos", F.lit(9)).withColumn("item_text", F.lit("no")).withColumn("skeleton", F.lit("no"))
    assert rows(unpack_fields(extra)) == [(1, "ingredients_raw", 0, "a"), (1, "ingredients_raw", 1, "b")]
    assert rows(unpack_fields(df.limit(0))) == []


def test_brackets_of_any_depth(spark):
    deep = "(" * 40 + "a, b" + ")" * 40
    text = f"milk {deep}, [egg; (x, [y, (z, {{u, (v, (w, (q, r), s))}})])], soy (open, end"
    want = [f"milk {deep}", "[egg; (x, [y, (z, {u, (v, (w, (q, r), s))})])]", "soy (open", "end"]
    data = [(1, text, T), (2, "milk (a, b), egg", T)]
    df = spark.createDataFrame(data, "label_id long, ingredients_raw string, observed_at timestamp").withColumns({"contains_raw": F.lit(None).cast("string"), "traces_raw": F.lit(None).cast("string")})
    assert [r.item_text for r in unpack_fields(df).where("label_id = 1").orderBy("pos").collect()] == want
    for flat in ("milk (a, b), egg", "(1) celery, (2) fish", "a 1,5 %; b & c | d", '"x, y", z', "a (b, c", "a) b, c (d, e)"):
        told = spark.createDataFrame([(flat,)], "t string").select(_pieces(F.col("t")).alias("p"), nesting(F.col("t")).alias("n")).first()
        assert told.p == cut_deep(flat) and told.n <= 1


def test_skeleton_rules():
    assert resolve_skeleton("oxcx") == [(0, 1), (2, 1)]
    assert resolve_skeleton("oxwx") == [(0, 3)]
    assert resolve_skeleton("wxwx") == [(0, 1), (2, 1)]
    assert resolve_skeleton("o_bxbx") == [(2, 1), (4, 1)]


# --- nested records ------------------------------------------------------------------------------------------------

trees = st.recursive(st.none() | st.integers(-9, 9) | st.text("ab", max_size=2), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from("xyz"), inner, max_size=3), max_leaves=12)


@given(st.lists(st.dictionaries(st.sampled_from("xyz"), st.integers(0, 9), max_size=3), max_size=4))
@settings(max_examples=60, deadline=None)
def test_levels_rebuild_a_list_of_objects(items):
    record = {"list": items}
    columns = shred(record)
    ancestor = ("list", EACH)
    if any(items):
        assert elements(columns, ancestor) == [(i,) for i in range(len(items))]
        for key in "xyz":
            assert values(columns, ancestor, (key,)) == [item.get(key) for item in items]


@given(trees)
@settings(max_examples=80, deadline=None)
def test_shredding_keeps_all_scalars(tree):
    def scalars(value):
        children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
        return [value] if children is None else [s for c in children for s in scalars(c)]

    kept = [v for column in shred(tree).values() for _, _, v in column if v is not None]
    assert sorted(map(str, kept)) == sorted(str(s) for s in scalars(tree) if s is not None)


def test_flatten(spark):
    tree = [{"raw": "a", "position": "1", "children": {"raw": "b", "position": 2.0, "children": []}}, None, {"raw": "c", "children": [{"raw": "d", "position": None}]}, "e"]
    payload = {"candidate": {"boundingBox": ["1", 2.0, 3, 4], "lines": [{"text": "t"}, {"boundingBox": {"height": 4, "x": "1", "y": 2, "width": 3}}]}, "normalizedIngredients": tree}
    data = [("d1", json.dumps(payload), T), ("d1", json.dumps(payload), T), ("d2", json.dumps(json.dumps({"boundingBox": [5, 6, 7, 8]})), T), ("d3", json.dumps(payload)[:-5], T), ("d4", None, T), ("d5", "{}", T), ("d6", "[1]", T), ("d7", "[" * 100_000, T), ("d8", "\ufeff" + json.dumps({"boundingBox": [1, 1, 2, 2]}), T), (None, "{}", T)]
    df = spark.createDataFrame(data, "decision_id string, payload string, decided_at timestamp").withColumn("kind", F.lit("clash"))
    assert rows(flatten_payloads(df)) == sorted(
        [
            ("d1", "ingredient", "0", "", 1, "a"),
            ("d1", "ingredient", "0.0", "0", 2, "b"),
            ("d1", "ingredient", "2", "", -1, "c"),
            ("d1", "ingredient", "2.0", "2", -1, "d"),
            ("d1", "ingredient", "3", "", -1, "e"),
            ("d1", "box", "", "", -1, "1,2,3,4"),
            ("d1", "box", "1", "", -1, "1,2,3,4"),
            ("d2", "box", "", "", -1, "5,6,7,8"),
            ("d8", "box", "", "", -1, "1,1,2,2"),
        ],
        key=str,
    )
    assert rows(flatten_payloads(df.limit(0))) == []


def test_whole_numbers_and_payloads():
    assert [whole_number(x) for x in (1, "2", 3.0, "4.5", None, True, "x", float("nan"), "inf")] == [1, 2, 3, 5, None, None, None, None, None]
    assert parse_whole('{"a":') is None and parse_whole(None) is None and parse_whole('"{}"') == {}


# --- snapshots -----------------------------------------------------------------------------------------------------

RUN = "run_id string, source_id string, source_complete boolean, started_at timestamp"
INDEX = "run_id string, source_record_id string, content_hash string, loaded_at timestamp"


def day(n):
    return datetime(2026, 1, n)


def test_snapshot_changes(spark):
    runs = spark.createDataFrame([("r1", "s", True, day(1)), ("r2", "s", False, day(2)), ("r3", "s", True, day(3)), ("r4", "s", True, day(4)), ("o1", "o", True, day(1)), (None, "s", True, day(5))], RUN)
    data = [
        ("r1", "123", "AA", day(1)), ("r1", "k", "b", day(1)), ("r1", "gone", "c", day(1)), ("r2", "k", "zz", day(2)),
        ("r3", " 00000000000123 ", "sha256:aa", day(3)), ("r3", "k", "old", day(3)), ("r3", "k", "new", day(4)), ("r3", "n", None, day(3)), ("r3", " ", "x", day(3)), ("r3", None, "x", day(3)),
        ("o1", "q", "h", day(1)), ("never", "q", "h", day(1)),
    ]
    index = spark.createDataFrame(data, INDEX).withColumn("change_kind", F.lit("clash")).withColumn("source_id", F.lit("wrong"))
    want = [("r3", "gone", "removed"), ("r3", "k", "changed"), ("r3", "n", "added"), *[("r4", k, "removed") for k in ("00000000000123", "k", "n")]]
    assert rows(snapshot_changes(index, runs)) == sorted(want, key=str)
    assert rows(snapshot_changes(index, runs, max_runs=1)) == sorted(want, key=str)
    assert rows(snapshot_changes(index.limit(0), runs)) == [] and rows(snapshot_changes(index, runs.limit(0))) == []


# --- quantities ----------------------------------------------------------------------------------------------------

PRODUCT = "label_id long, observed_at timestamp, net_quantity_grams double, net_quantity_unit string, net_quantity_text string, serving_size_grams double, serving_size_unit string, serving_size_text string"
VALUE = "value_id long, observed_at timestamp, label_id long, nutrient_code string, quantity string, unit string, basis string"


def net(spark, text=None, number=None, unit=None):
    df = spark.createDataFrame([(1, T, number, unit, text, None, None, None)], PRODUCT)
    found = common_amounts(df, spark.createDataFrame([], VALUE)).collect()
    return [(r.unit, r.amount) for r in found]


@pytest.mark.parametrize(
    ("given_", "want"),
    [
        (("6 x 500 grams",), ("g", 3_000_000)),
        (("200 millilitres x 6",), ("ml", 1_200_000)),
        (("35.3 oz (1000G)",), ("g", 1_000_000)),
        (("Net Wt. 1,1OZ",), ("g", 31_184)),
        (("1½ kg",), ("g", 1_500_000)),
        (("quarter kg",), ("g", 250_000)),
        (("CL 33",), ("ml", 330_000)),
        (("1,000 gms",), ("g", 1_000_000)),
        (("0,925 KG",), ("g", 925_000_000)),
        (("६० g",), ("g", 60_000)),
        (("16.9 fl. oz",), ("ml", 499_793)),
        (("250", None, "ml"), ("ml", 250_000)),
        (("see pack", 0.5, "Kg"), ("g", 500_000)),
        ((None, 250.0, None), ("g", 250_000)),
        ((None, 250.0, "furlong"), None),
        ((None, float("nan"), "g"), None),
        ((None, None, "g"), None),
        (("1," * 50_000 + "1 g",), None),
        (("9" * 50_000 + " g",), None),
        (("word " * 50_000 + "7 g",), ("g", 7_000)),
    ],
)
def test_net_quantity(spark, given_, want):
    assert net(spark, *given_) == ([want] if want else [])


def test_nutrients_and_awkward_rows(spark):
    labels = spark.createDataFrame([(1, T, None, None, None, 33.3, None, "30 g"), (1, T, None, None, None, 33.3, None, "30 g"), (2, T, None, None, None, 0.0, None, None), (None, T, 1.0, None, None, None, None, None)], PRODUCT)
    data = [
        (10, T, 1, "fat", "12,5 mg", "g", "per_100g"), (11, T, 1, "fat", "3", "g", "per portion"), (12, T, 1, "energy", "418.4", "kJ", "/100g"), (13, T, 2, "fat", "3", "g", "serving"),
        (14, T, 1, "fat", "3", "g", "unknown"), (15, T, 1, "fat", None, "g", "100g"), (16, T, 1, "energy", "3", "g", "100g"), (17, T, 1, "fat", "~0.0005", None, "100ML"), (10, T, 1, "fat", "12,5 mg", "g", "per_100g"),
    ]
    nutrients = spark.createDataFrame(data, VALUE).withColumn("kind", F.lit("clash")).withColumn("s", F.lit(1))
    found = rows(common_amounts(labels, nutrients))
    assert found == sorted([("serving", 1, "g", 30_000), ("serving", 2, "g", 0), ("nutrient", 10, "g", 13), ("nutrient", 11, "g", 10_000), ("nutrient", 12, "kcal", 100_000), ("nutrient", 17, "g", 1)], key=str)
    assert rows(common_amounts(labels.limit(0), nutrients.limit(0))) == []


def test_scales_are_estimated_snapped_and_propagated(spark):
    texts = [(i, f"{round(g / 28.349523125, 1)} oz ({g} Krumm)") for i, g in enumerate((500, 900, 1200, 2000))] + [(9, "3 oz / 85 g")]
    scales = pairwise_scales(observations(spark.createDataFrame(texts, "entity long, text string")))
    pair = {(r.source_a, r.source_b): r for r in scales.collect()}
    assert pair["krumm", "oz"].known == pytest.approx(1 / 28.349523125) and pair["g", "oz"].known is None
    learned = {r.source: r.factor for r in propagate(scales, seeds(spark)).collect()}
    assert learned["krumm"] == pytest.approx(1000.0)
