"""Reference operators: fixed expression constants, small cases, and every SQL oracle on the smallest data."""

import gzip
import json
import random
import re
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.functions import jsons, nutrition as nu, text as tx, times
from granary.operators import entities, evidence, ledgers, pages, relational as rel, trees, upserts
from granary.plans import evidence_queries, problem_queries, reference_queries
from granary.session import shared_folder
from granary.sources import files
from granary.streaming.staging import upsert_stream

SQL = {**reference_queries.ORACLE, **evidence_queries.ORACLE, **problem_queries.ORACLE}
QUERIES = {**reference_queries.QUERIES, **evidence_queries.QUERIES, **problem_queries.QUERIES}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain(value):
    if hasattr(value, "as_py"):
        value = value.as_py()
    return None if value is None or value != value else round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def oracle(folder):
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, folder, oracle, name):
    found, want = QUERIES[name](spark, folder).toArrow(), oracle.sql(SQL[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(want.column_names)
    as_rows = lambda t: sorted((tuple(map(plain, r)) for r in zip(*[t.column(c).to_pylist() for c in columns])), key=str)
    assert as_rows(found) == as_rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() >= 0


def test_plans_have_no_nested_loop_or_cartesian_join(spark, folder):
    for name in ("exists_in_or", "unanimous_key", "prefix_candidates", "entity_resolution", "proof_join", "strict_trust"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def value(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def metrics(spark, kcal, protein, net=None, basis="per_100g"):
    none = F.lit(None).cast("double")
    number = lambda v: F.lit(v).cast("double")
    made = nu.nutrition_metrics(number(kcal), number(protein), none, none, none, number(net), F.lit(basis))
    return {k: value(spark, m) for k, m in made.items()}


def test_metric_constants(spark):
    m = metrics(spark, 360, 52, 500)
    assert m["protein_per_100_kcal"].value == pytest.approx(14.444, abs=1e-3) and m["protein_energy_percent"].value == pytest.approx(57.778, abs=1e-3) and m["protein_in_pack"].value == 260
    m = metrics(spark, 50, 10, basis="per_100ml")
    assert (m["protein_per_100_kcal"].value, m["protein_energy_percent"].value, m["kcal_per_25g_protein"].value) == (20, 80, 125)
    assert m["protein_in_pack"].value is None and m["protein_in_pack"].reason == "nutrition_basis_not_mass_normalized"
    m = metrics(spark, 115, 29)
    assert {m[k].reason for k in ("protein_per_100_kcal", "protein_energy_percent", "kcal_per_25g_protein")} == {"protein_energy_exceeds_total"}
    assert metrics(spark, 100, 0)["kcal_per_25g_protein"].reason == "invalid_input"
    assert metrics(spark, None, 1)["protein_per_100_kcal"].reason == "missing_protein_or_calories"


def test_completeness_constant(spark):
    fields = {"gtin": "1", "brand": "b", "name": "n", "netQuantityGrams": None, "nutrition": None, "ingredients": "", "evidence": None, "offer": None}
    got = value(spark, nu.completeness({k: F.lit(v).cast("string") for k, v in fields.items()}))
    assert got.score == 38 and got.missing == ["netQuantityGrams", "nutrition", "ingredients", "evidence", "offer"]


def test_validation_rules(spark):
    def codes(basis="per_100g", **values):
        return {(r.code, r.severity) for r in value(spark, nu.validation_issues({k: F.lit(v).cast("double") for k, v in values.items()}, F.lit(basis)))}

    assert codes(calories=360, protein=30, carbohydrate=45, fat=6.6) == set()
    assert ("calorie_macro_mismatch", "error") in codes(calories=0, protein=1, carbohydrate=1, fat=1) and ("non_positive_energy", "error") in codes(calories=0)
    assert ("calorie_macro_mismatch", "warning") in codes(calories=300, protein=10, carbohydrate=30, fat=5)
    assert {c for c, _ in codes(calories=950, protein=101, carbohydrate=5, sugar=6, fat=5, saturated_fat=6, fibre=float("nan"))} >= {"energy_over_physical_maximum", "nutrient_over_100g", "sugar_exceeds_carbohydrate", "saturated_fat_exceeds_fat", "invalid_numeric_value", "macro_total_impossible"}
    assert ("energy_over_physical_maximum", "error") not in codes("per_100ml", calories=950)


def test_status_energy_and_serving(spark):
    step = lambda now, verified, conflict: value(spark, nu.next_status(F.lit(now), F.lit(verified), F.lit(conflict)))
    assert [step("verified", False, True), step("missing", True, False), step("missing", False, False), step("unverified", False, True)] == ["conflict", "verified", "unverified", "unverified"]
    n = lambda v: F.lit(v).cast("double")
    assert value(spark, nu.corrected_energy(n(400), n(40), n(40), n(5))) == 400 and value(spark, nu.corrected_energy(n(1674), n(40), n(40), n(5))) == pytest.approx(400.1, abs=0.1)
    states = [value(spark, nu.serving_evidence(n(a), n(b), n(p))).state for a, b, p in ((30, 30.2, 500), (30, 40, 500), (None, 600, 500), (None, None, 5), (30, None, None))]
    assert states == ["corroborated", "conflict", "implausible", "missing", "single"]
    assert value(spark, nu.relative_difference(n(100), n(80))) == pytest.approx(0.2) and value(spark, nu.per_100(n(6), n(30))) == 20 and value(spark, nu.per_100(n(6), n(0))) is None


def test_gtin_and_text(spark):
    codes = {"8900000000012": "08900000000012", "8900000000013": None, "0 12345-678905": "00012345678905", "96385074": "00000096385074", "123": None, "N/A": None, "": None, None: None, "10012345678902": "10012345678902"}
    for raw, want in codes.items():
        assert value(spark, tx.gtin14(F.col("x")), "x string", (raw,)) == want, raw
    assert value(spark, tx.normalize_text(F.lit("Crème & Co™ β-Alanine"))) == "creme and co beta alanine" and value(spark, tx.normalize_text(F.lit(None).cast("string"))) == ""
    assert value(spark, tx.normalize_text(F.col("x")), "x string", ("ﬁne ½ Ｗｈｅｙ",)) == "fine 1 2 whey"
    assert value(spark, tx.composite_key(F.lit("A"), F.lit("B"), F.lit("c"), F.lit(500.0))) == "a|b|c|500" and value(spark, tx.composite_key(F.lit("A"), F.lit("B"), F.lit(None).cast("string"), F.lit(500.0))) is None
    assert value(spark, tx.declared_pack_grams(F.lit("Whey 2 kg"), F.lit(None).cast("string"))) == 2000 and value(spark, tx.declared_pack_grams(F.lit("Whey, 500 g"), F.lit(""))) == 500 and value(spark, tx.declared_pack_grams(F.lit("Whey"), F.lit("Net qty: 1 kg"))) == 1000
    assert value(spark, tx.additive_codes(F.lit("INS 322, colour 150d"), F.array(F.lit("en:e471")))) == ["INS 322", "INS 150D", "INS 471"]
    assert value(spark, tx.invalid_percentages(F.lit("a 20%, b 120 %"))) == [120.0] and value(spark, tx.clean_tag(F.lit("en:tree-nuts"))) == "tree nuts"
    assert [value(spark, tx.is_https_url(F.lit(u))) for u in ("https://a.example/x", "http://a.example", "https://u@a.example", "")] == [True, False, False, False]
    assert value(spark, tx.html_to_text(F.lit("<p>a&nbsp;b</p><b>c</b>&amp;"))) == " a b\n c &" and value(spark, tx.label_reference(F.lit("https://i.example/p/front_en.12.400.jpg"))).asDict() == {"tail": "front_en.12.400.jpg", "revision": 12, "image_id": "front_en"}
    assert value(spark, tx.reason_codes_ok(F.array(F.lit("a.b"), F.lit("c_1")))) and not value(spark, tx.reason_codes_ok(F.array(F.lit("A"))))
    assert value(spark, tx.in_country(F.lit("en:india,fr"), F.lit(""), "india")) and not value(spark, tx.in_country(F.lit(""), F.lit("Indiana"), "india"))
    assert value(spark, tx.comparable_text(F.col("x")), "x string", ("  Ａ  b ",)) == "a b"


def test_normalized_text_of_all_characters(spark):
    chars = [c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    texts = [" x".join(chars[i : i + 64]) for i in range(0, len(chars), 64)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_text(F.col("t")).alias("n")).collect()
    assert all(r.n == tx.plain_text(r.t) for r in found) and len(found) == len(texts)


def test_times_and_json(spark):
    assert value(spark, times.is_canonical(F.lit("2026-01-01T00:00:00.000Z"))) and not value(spark, times.is_canonical(F.lit("2026-01-01")))
    stamp = lambda t, e: value(spark, times.canonical_time(times.observation_time(F.lit(t), F.lit(e).cast("double"))))
    assert [stamp("2026-01-01T02:00:00+02:00", None), stamp("x", 86400.0), stamp(None, None)] == ["2026-01-01T00:00:00.000Z", "1970-01-02T00:00:00.000Z", "1970-01-01T00:00:00.000Z"]
    digest = lambda t: value(spark, jsons.canonical_json_hash(F.col("x")), "x string", (t,))
    assert digest('{"b": 1.0, "a": [true]}') == digest('{"a":[true],"b":1}') and digest("{") is None and digest(None) is None
    assert value(spark, jsons.is_json(F.lit("[1]"))) and not value(spark, jsons.is_json(F.lit("[")))
    assert value(spark, jsons.unknown_keys(F.lit('{"a":1,"z":2}'), ["a"])) == ["z"] and value(spark, jsons.append(F.array(F.lit("a")), F.lit("b"))) == ["a", "b"]


def test_fold_is_ordered_and_idempotent(spark):
    schema = "k string, n int, auth int, at int, filled int"
    df = spark.createDataFrame([("a", 1, 5, 10, 3), ("a", 2, 5, 20, 2), ("a", 3, 5, 15, 3), ("a", 4, 4, 99, 9), ("b", 1, 1, 1, 1), ("c", 1, 1, 50, 5), ("c", 2, 9, 1, 0), ("c", 3, 9, 2, 0)], schema)
    once = upserts.fold_by_precedence(df, "k", ["n"], "auth", "at", "filled", ["n"])
    assert rows(once) == [("a", 3), ("b", 1), ("c", 3)]
    assert rows(upserts.fold_by_precedence(df.union(df), "k", ["n"], "auth", "at", "filled", ["n"])) == rows(once)


def test_upserts_and_violations(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("a", 2, None), ("b", 4, "n"), ("c", 1, "z")], "k string, v int, s string")
    merged = upserts.upsert_total_order(old, new, ["k"], ["v"])
    assert rows(merged) == [("a", 2, None), ("b", 5, "y"), ("c", 1, "z")] and rows(upserts.upsert_total_order(merged, new, ["k"], ["v"])) == rows(merged)
    gate = F.col("n.v") >= F.col("o.v")
    assert rows(upserts.merge_columns(old, new, "k", {"v": "overwrite", "s": "keep"}, gate)) == [("a", 2, "x"), ("b", 5, "y"), ("c", 1, "z")]
    assert rows(upserts.rehome(new.select("k", "v"), spark.createDataFrame([("a", "z")], "old string, new string"), "k")) == [("b", 4), ("c", 1), ("z", 2)]
    assert rows(upserts.violations(new, {"s": F.col("s") != "n"}, "k")) == [("a", "s"), ("b", "s")]


def test_ingredient_upsert_merges_into_held_rows(spark, folder, monkeypatch):
    seen, upsert = [], upserts.upsert_total_order
    monkeypatch.setattr(upserts, "upsert_total_order", lambda old, new, *rest: seen.append((old.count(), new.count())) or upsert(old, new, *rest))
    QUERIES["upsert_precedence_ingredient"](spark, folder)
    assert any(old > 0 and new > 0 for old, new in seen)


def test_entities_and_candidates(spark):
    schema = "id long, gtin string, composite string"
    candidates = spark.createDataFrame([(1, "g1", "c1"), (2, "g2", "c2"), (3, "g2", "c2"), (4, None, "c4")], schema)
    incoming = spark.createDataFrame([(10, "g1", None), (11, "g2", None), (12, None, "c4"), (13, None, "c2"), (14, None, None), (15, "g9", "c9")], schema)
    assert rows(entities.resolve_entities(incoming, candidates)) == [(10, 1, "exact_gtin"), (11, None, "duplicate_canonical_gtin"), (12, 4, "exact_composite"), (13, None, "ambiguous_exact_composite"), (14, None, "insufficient_exact_identity"), (15, None, "no_exact_match")]
    named = spark.createDataFrame([(1, "b", "whey gold"), (2, "b", "whey gold plus"), (3, "b", "whey goldie"), (4, "c", "whey gold"), (5, "b", "whey gold")], "id long, b string, n string")
    assert rows(rel.prefix_candidates(named, named, "b", "n", "id", "id")) == [(1, 2, 78), (1, 5, 92), (2, 1, 78), (2, 5, 78), (5, 1, 92), (5, 2, 78)]


def test_signs_and_ampersands_are_resolved_by_the_operator(spark, tmp_path):
    rest = "gtin string, brand string, item_name string, flavour string, net_quantity_grams double"
    listings = [(1, None, "Kelba", "Whey™ Gold", "Cookies & Cream", 500.0), (2, None, "Kelba", "Whey", "Mint", 500.0)]
    spark.createDataFrame(listings, f"listing_id long, {rest}").write.parquet(str(tmp_path / "listings.parquet"))
    spark.createDataFrame([(9, None, "KELBA®", "Whey Gold", "Cookies and Cream", 500.0)], f"label_id long, {rest}").write.parquet(str(tmp_path / "label_products.parquet"))
    assert rows(QUERIES["entity_resolution"](spark, str(tmp_path))) == [(1, 9, "exact_composite"), (2, None, "no_exact_match")]


def test_relational_pieces(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, None)], "k string, n int, v string")
    assert rows(rel.unanimous(df, ["k"], "v")) == [("a", "x")]
    assert rows(rel.top_n(df, ["k"], [F.desc("n")], 1).select("k", "n")) == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(rel.search(df, "X", ["v"]).select("k").distinct()) == [("a",), ("b",)] and rel.search(df, "", ["v"]).count() == 5
    assert rows(rel.partition_check(df.select("k").distinct(), spark.createDataFrame([("a",), ("d",), ("a",)], "k string"), "k")) == [("a", "duplicate"), ("b", "missing"), ("c", "missing"), ("d", "unexpected")]
    assert rows(rel.supersession_heads(spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id int, of int"), "id", "of").select("id")) == [(3,), (9,)]
    with pytest.raises(ValueError):
        rel.page(df, [F.asc("n")], 0, 10)
    assert rows(rel.set_difference_counts(df, df.where("k != 'a'"), ["k"])) == [(3, 2, 1, 0, False)]
    assert rows(ledgers.cross_conflict(df.withColumn("z", F.lit(None).cast("double")), ["k"], ["n", "z"], 0.4).select("k", "conflict")) == [("a", True), ("b", True), ("c", False)]
    assert rows(ledgers.dedupe_ledger(df, "k", "v").select("k", "state")) == [("a", "same"), ("b", "conflict"), ("c", "same")]


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (7, 8), (8, 7)], "id int, parent int")
    assert rows(trees.tree_paths(nodes, "id", "parent")) == [(1, 0, "1"), (2, 1, "1>2"), (3, 2, "1>2>3"), (4, 1, "1>4")]
    with pytest.raises(ValueError):
        trees.tree_paths(nodes, "id", "parent", max_depth=1)
    text = spark.createDataFrame([("x", "Whey (milk 90%, soy & salt), cocoa 120% & R-&-D [a; b]"), ("y", None), ("z", " ")], "id string, t string")
    got = {r.path: (r.parent_path, r.position, r.name, r.percentage) for r in trees.ingredient_nodes(text, "id", "t").collect()}
    assert got == {"0": ("", 0, "whey", 90.0), "0.0": ("0", 0, "milk", 90.0), "0.1": ("0", 1, "soy", None), "0.2": ("0", 2, "salt", None), "1": ("", 1, "cocoa", None), "2": ("", 2, "r and d", None), "2.0": ("2", 0, "a", None), "2.1": ("2", 1, "b", None)}
    parts = spark.createDataFrame([(1, "milk", "contains"), (1, "milk", "source_tag"), (1, "egg", "source_tag"), (1, "", "contains")], "id int, name string, declaration string")
    assert rows(trees.allergen_declarations(parts)) == [(1, "egg", "source_tag"), (1, "milk", "contains")]


def test_trees_are_rebuilt(spark):
    text = spark.createDataFrame([("x", "Whey (milk 90%, soy & salt [a; b]), cocoa"), ("y", "oats")], "id string, t string")
    told = {r.id: json.loads(r.tree) for r in trees.rebuild_trees(trees.ingredient_nodes(text, "id", "t"), "id").collect()}
    leaf = lambda raw, at: {"raw": raw, "position": at, "children": []}
    salt = {"raw": "salt [a; b]", "position": 2, "children": [leaf("a", 0), leaf("b", 1)]}
    assert told == {"x": [{"raw": "Whey (milk 90%, soy & salt [a; b])", "position": 0, "children": [leaf("milk 90%", 0), leaf("soy", 1), salt]}, leaf("cocoa", 1)], "y": [leaf("oats", 0)]}


def test_a_cluster_without_a_shared_folder_is_an_error():
    unset = SimpleNamespace(isEmpty=lambda: True, isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_split_against_brute_force():
    rng = random.Random(1)
    for _ in range(3_000):
        text = "".join(rng.choice("ab ,;&-()[]") for _ in range(rng.randint(0, 24)))
        depth, parts, part = 0, [], ""
        for i, c in enumerate(text):
            depth = max(0, depth + (c in "([") - (c in ")]"))
            if depth == 0 and c in ",;&" and not (c == "&" and text[:i].rstrip().endswith("-")):
                parts, part = [*parts, part], ""
            else:
                part += c
        assert trees.split_top_level(text) == [p.strip() for p in [*parts, part] if p.strip()]


def test_evidence_pieces(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("b", 1, 2), ("b", None, 2), ("c", 3, 4)], "k string, x int, y int")
    assert rows(rel.uncontradicted(df, ["k"], ["x", "y"]).select("k")) == [("a",), ("a",), ("c",)]
    assert rows(rel.membership_join(df.where("k = 'c'"), "x", spark.createDataFrame([(1, 3, 3), (2, None, 9)], "id int, p int, q int"), F.array("p", "q")).select("k", "id")) == [("c", 1)]
    told = spark.createDataFrame([(1, "failed"), (1, "candidate"), (2, "rejected")], "k int, o string")
    assert rows(evidence.role_outcomes(spark.createDataFrame([(1,), (3,), (3,)], "k int"), told, "k", "o", ["candidate", "rejected", "failed"])) == [(1, "requested", "candidate"), (2, "prediction", "rejected"), (3, "requested", "no_prediction")]
    assert rows(evidence.text_conflicts(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None)], "k int, t string"), ["k"], F.col("t")).select("k")) == [(1,)]
    e = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, None), (3, 1.0, 1.0)], "k int, p double, q double")
    a = spark.createDataFrame([(1, 2.1, None), (2, 2.9, 1.0)], "k int, p double, q double")
    assert rows(evidence.benchmark_errors(e, a, ["k"], ["p", "q"], 0.5)) == [(1, "q_missing"), (2, "p_differs,q_unexpected"), (3, "row_missing")]
    assert [r.n for r in rel.page_after(spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "id int, n int"), "n", "id", 2, (5, 1)).collect()] == [5, 4]


def test_allergens_of_bracketed_and_numbered_fields(spark, tmp_path):
    texts = [
        ("a", "(1) celery, (2) fish", "nuts (almond, cashew); sesame"), ("b", '["Tree nuts", "Peanuts"]', "en:tree-nuts, en:milk"), ("c", "milk & soy", "R-& D, milk & soy"),
        ("d", None, ""), ("e", "egg, egg, ,", "(none) ] a, b"), ("c", "milk & soy", "R-& D, milk & soy"),
    ]
    spark.createDataFrame(texts, "label_id string, contains_raw string, traces_raw string").write.parquet(str(tmp_path / "label_products.parquet"))

    def brute(text):
        depth, cuts = 0, [-1]
        for i, c in enumerate(text or ""):
            depth = depth + (c in "([") if c not in ")]" else max(0, depth - 1)
            if depth == 0 and (c in ",;" or c == "&" and not text[cuts[-1] + 1 : i].rstrip().endswith("-")):
                cuts.append(i)
        parts = [(text or "")[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], None])]
        plain = [re.sub("^[a-z]{2}:", "", p.strip(), flags=re.I).replace("-", " ").lower().replace("&", " and ") for p in parts]
        return {" ".join(re.findall("[a-z0-9]+", p)) for p in plain} - {""}

    want = {(k, n, kind) for k, *both in texts for text, kind in zip(both, ("contains", "may_contain")) for n in brute(text)}
    found = rows(QUERIES["allergen_declarations"](spark, str(tmp_path)))
    assert found == sorted(want, key=str)
    assert {("a", "1 celery", "contains"), ("a", "2 fish", "contains"), ("a", "nuts almond cashew", "may_contain"), ("b", "tree nuts peanuts", "contains"), ("b", "milk", "may_contain")} <= set(found)


def test_pages(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "ProductGroup", "hasVariant": [{"@type": "Product", "name": "A", "brand": {"name": "B"}, "gtin13": "1"}, {"@type": "Offer"}]}]}</script>'
    micro = '<div itemprop="name">Tea &amp; Oats</div><meta itemprop="sku" content="s1">'
    table = "<p>Nutrient | Per 100 g | Per serve</p><p>--- | --- | ---</p><p>Energy | 380 kcal | 90 kcal</p><p>Protein | 25 g | 6 g</p><p>Sodium | 120 mg | x</p>"
    html = spark.createDataFrame([(1, "<script type='application/ld+json'>{bad</script>" + ld), (2, micro), (3, "plain"), (4, None), (5, table), (6, table + table)], "id int, html string")
    assert rows(pages.products_of_pages(html, "id", "html")) == [("1", 0, "A", "B", None, "1", "json_ld"), ("2", 0, "Tea & Oats", None, "s1", None, "microdata")]
    assert rows(pages.nutrition_tables(html, "id", "html")) == [(5, "calories", 380.0), (5, "protein", 25.0), (5, "sodium", 120.0)]
    assert pages.embedded_object('x = {"a": "}", "b": {}} ;', "x =") == {"a": "}", "b": {}} and pages.embedded_object("none", "x") is None and pages.embedded_object("x = {", "x") is None


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as out:
        out.write('code\tname\tfat_100g\tfat_value_100g\n1\t"q"\t2.5\t9\n2\tb\t-1\t9\n2\tc\n')
    assert files.format_of("a.TSV.gz") == "tsv" and files.format_of("a.jsonl") == "jsonl"
    with pytest.raises(ValueError):
        files.format_of("a.xml")
    raw = files.read_tsv(spark, str(tmp_path / "a.tsv.gz"))
    assert rows(raw.select("code", "name")) == [("1", '"q"'), ("2", "b"), ("2", "c")]
    assert rows(files.unpivot_per_100(raw, "code")) == [("1", "fat", 2.5)]
    numbered = raw.withColumn("n", F.monotonically_increasing_id())
    staged, excluded = files.stage(numbered, "code", ["name"], {"no_name": F.col("name") == '"q"'}, "n")
    assert rows(staged.select("code", "name")) == [("2", "b")] and rows(excluded.select("code", "reasons")) == [("1", ["no_name"]), ("2", ["duplicate_source_key"])]
    assert files.manifest(staged, excluded, {"name": "name"}).first().asDict() == {"staged": 1, "with_name": 1, "excluded": 2, "duplicates": 1, "read": 3}
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nnot json\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), StructType().add("a", "integer"))) == [(1, None), (None, "not json")]
    assert files.continuity_issues({"n": 100, "m": 10}, {"n": 80, "m": 10}, 0.1) == ["n"]


def test_bundles(tmp_path):
    bundle = files.write_bundle([{"id": "b", "x": 1}, {"id": "a"}], tmp_path, "nutrition")
    folder = tmp_path / bundle
    assert files.write_bundle([{"id": "a"}, {"id": "b", "x": 1}], tmp_path, "nutrition") == bundle and files.checksum_issues(folder) == []
    assert [json.loads(line)["id"] for line in (folder / "decisions.jsonl").read_text().splitlines()] == ["a", "b"]
    (folder / "decisions.jsonl").write_text("x")
    (folder / "more").write_text("x")
    with (folder / "checksums.sha256").open("a") as out:
        out.write("00  ../up\n")
    assert files.checksum_issues(folder) == ["changed:decisions.jsonl", "unlisted:more", "unsafe:../up"]


def test_stream_of_upserts(spark, tmp_path):
    schema = "k string, v int"
    for i, batch in enumerate(([("a", 1), ("b", 1)], [("a", 3), ("c", 1)], [("a", 2)])):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["v"]).awaitTermination()
        last = spark.read.parquet(str(tmp_path / f"out/v={i}"))
    assert rows(last) == [("a", 3), ("b", 1), ("c", 1)]


def test_current_rows_break_ties(spark):
    moment = datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", moment, 1), ("a", moment, 2), ("b", None, 3)], "k string, at timestamp, n int")
    assert rows(rel.top1(df, ["k"], [F.col("at"), F.col("n")], ["n"])) == [("a", 2), ("b", 3)]
