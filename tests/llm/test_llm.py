"""The operators tagged llm: small cases, awkward inputs, brute force and held-out accuracy."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.llm.canonical import map_to_canonical
from granary.llm.leaks import leaked_items
from granary.llm.listings import flavour_key, quantity_of
from granary.llm.mixing import allocate, mix, short_sources, sized_documents
from granary.llm.names import NameMatcher, allowed_edits, edits, folded
from granary.llm.near import near_pairs
from granary.llm.queries import QUERIES
from granary.llm.resolve import PROFILE, merge_profiles, product_pairs, representative_pairs, same_products
from granary.llm.spam import NAMES, NUMBER, Batch, Model, classes_of, pieces_of, spam_pages
from granary.llm.survivors import claims_of, discover_truth, observed_time, surviving_values

T = datetime(2026, 1, 1)
BRANDS = "brand_source_id string, brand_name string, brand_aliases array<string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- names -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def brands(spark):
    return spark.createDataFrame(
        [("kil", "Killona Nutrition", None), ("gen", "Genfifem", []), ("ter", "Terkatru Foods", ["Kelbizen Naturals"]), ("kli", "Klisbadom", ["klisbadom1"]), ("mel", "Melklipal Mills", None), ("dol", "Dolbodus Naturals", None), ("bre", "Brezodrom Dairy", None), ("tri", "Trinpifi Foods", None), ("sen", "Senedren Foods", None), ("x", None, None)],
        BRANDS,
    )


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("Visit the Killona Nutrition Store", "kil"), ("killona", "kil"), ("Genf1f3m", "gen"), ("Gеnfifеm", "gen"), ("gen fifem", "gen"), ("Ter-katru", "ter"), ("KELBIZEN", "ter"), ("Kelbizn Naturalls", "ter"),
        ("klisbaodm1", "kli"), ("MelklipalMills", "mel"), ("Melkipal™ Pvt Ltd", "mel"), ("Brezudrug Organics", "none"), ("Generic", "none"), ("N/A", "none"), ("Some Foods", "none"), ("???", "none"),
    ],
)
def test_brand_mapping(spark, brands, typed, want):
    df = spark.createDataFrame([(1, typed, T, T)], "listing_id long, brand string, observed_at timestamp, ingested_at timestamp")
    assert rows(map_to_canonical(df, brands)) == [(1, want)]


def test_brand_mapping_awkward_rows(spark, brands):
    data = [(1, "Genfifem", T, T), (1, "Genfifem", T, T), (2, None, T, T), (3, "  ", T, T), (None, "Genfifem", T, T), (4, "x" * 50_000, T, T)]
    df = spark.createDataFrame(data, "listing_id long, brand string, observed_at timestamp, ingested_at timestamp").withColumn("brand_source_id", F.lit("clash")).withColumn("value", F.lit(1))
    assert rows(map_to_canonical(df, brands)) == [(1, "gen"), (4, "none")]
    assert rows(map_to_canonical(df, brands.limit(0))) == [(1, "none"), (4, "none")]
    assert rows(map_to_canonical(df.limit(0), brands)) == []
    assert rows(map_to_canonical(df, brands, max_entries=1)) == [(1, "gen"), (4, "none")]  # a list beyond the bound is no error


def test_long_lists_are_matched_in_blocks(spark, folder):
    listings, entries = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("listings", "brand_sources"))
    whole = rows(map_to_canonical(listings, entries))
    assert rows(map_to_canonical(listings, entries, max_entries=60)) == whole and len({k for _, k in whole}) > 20
    typed = spark.createDataFrame([(1, "Rivr Ambr", T), (2, "amber rivers", T), (3, "Stone Lantern Mill", T), (4, "???", T)], "listing_id long, brand string, observed_at timestamp").withColumn("ingested_at", F.lit(T))
    names = spark.createDataFrame([("a", "Amber River", None), ("l", "Lantern Stone", ["Stony Lane"]), ("x", "Plain Foods", None)], BRANDS)
    assert rows(same_products(listings, entries, max_entries=60)) == rows(same_products(listings, entries))
    assert rows(map_to_canonical(typed, names, max_entries=2)) == rows(map_to_canonical(typed, names)) == [(1, "a"), (2, "a"), (3, "l"), (4, "none")]


def test_matcher_against_brute_force():
    rng = random.Random(5)
    names = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(120)]
    matcher = NameMatcher.of([(n, n) for n in names])
    for _ in range(300):
        word = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            word[rng.randrange(len(word))] = rng.choice("abcdefghij")
        typed = "".join(word)
        far = min(edits(typed, n, 3) for n in names)
        found = matcher.match(typed)
        assert (found is None) == (far > 2) and (found is None or edits(typed, found, 3) == far)


def test_names_of_several_words_match_in_any_order():
    matcher = NameMatcher.of([("ar", "Amber River"), ("as", "Amber Stone Foods"), ("ol", "Old Harbour Lane"), ("x", "Kelba Foods"), ("y", "Zodrim Foods"), ("z", "Parnu Foods")])
    typed = {"Rivr Ambr": "ar", "River Amber": "ar", "Ston Ambre Foods": "as", "Lane Harbuor Old": "ol", "Amber Foods Rivre Whey": "ar", "Harbour Whey Snack Ambr": None, "Amber Lane": None, "Foods": None}
    assert {t: matcher.match(t) for t in typed} == typed


def test_folding():
    assert folded("  Napézöm™  Foods®") == "napezom foods" and folded(None) == "" and edits("abcd", "abdc", 2) == 1


# --- products --------------------------------------------------------------------------------------------------------

LISTING = "listing_id long, brand string, item_name string, flavour string, net_quantity_grams double, observed_at timestamp, ingested_at timestamp"


def listing(key, brand, name, flavour, net=None):
    return (key, brand, name, flavour, net, T, T)


def test_same_products(spark, brands):
    lines = ["Voranis", "Ribala", "Thozantis"]
    filler = [listing(1000 + i, "Killona Nutrition", f"{line} Mass Gainer {size} kg", taste, None) for i, (line, size, taste) in enumerate((line, size, taste) for line in lines for size in (1, 3, 5) for taste in ("Mocha", "Vanilla", "Milk Chocolate", "Banana"))]
    filler += [listing(2000 + i, "Genfifem", f"{line} Protein Bar 30 g x {n}", "Mango", None) for i, (line, n) in enumerate((line, n) for line in lines for n in (6, 12) for _ in range(2))]
    cases = [
        listing(1, "Genfifem", "Voranis Peanut Butter Crunchy 500g x 2", "Vanilla"),
        listing(2, "by gen fifem", "CRUNCHY PEANUT BUTTER VORANIS - Pack of 2 - vanila flavor", None, 1.0),
        listing(3, None, "Genfifem Vorannis PB Crunchy Peanut Spread 17.6 oz each (2 pcs)", "Vanilla Flavour"),
        listing(4, "Genfifem", "Voranis Peanut Butter Creamy 500g x 2", "Vanilla"),
        listing(5, "Genfifem", "Voranis Peanut Butter Crunchy 500g", "Vanilla"),
        listing(6, "Genfifem", "Voranis Peanut Butter Crunchy", "Vanilla"),
        listing(7, "Genfifem", "Voranis Peanut Butter Crunchy 500g x 2", None),
        listing(8, "Killona Nutrition", "Voranis Peanut Butter Crunchy 500g x 2", "Vanilla"),
        listing(1, "Genfifem", "Voranis Peanut Butter Crunchy 500g x 2", "Vanilla"),
        listing(9, None, None, None), listing(None, "Genfifem", "Voranis Skyr 100 g", "Mocha"), listing(10, "Genfifem", "word " * 20_000, "Vanilla", 100.0),
    ]
    df = spark.createDataFrame(filler + cases, LISTING).withColumn("product", F.lit("clash")).withColumn("id", F.lit(0))
    pairs = {p for p in rows(product_pairs(same_products(df, brands))) if p[0] < 100 and p[1] < 100}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    assert rows(product_pairs(same_products(df.limit(0), brands))) == []


def test_rare_lines_are_products_of_their_own(spark, brands):
    lines = ["Voranis", "Ribala", "Thozantis"]
    filler = [listing(1000 + i, "Killona Nutrition", f"{line} Mass Gainer {size} kg", taste) for i, (line, size, taste) in enumerate((line, size, taste) for line in lines for size in (1, 3, 5) for taste in ("Mocha", "Vanilla", "Banana"))]
    cases = [
        listing(1, "Genfifem", "Voranis Peanut Butter Crunchy 500g", "Vanilla"), listing(2, "Genfifem", "Voranis Peanut Butter Crunchy 500g", "Vanilla"),
        listing(3, "Genfifem", "Kembulex Peanut Butter Crunchy 500g", "Vanilla"), listing(4, "Genfifem", "Kembulex Peanut Butter Crunchy 500g", "Vanilla"),
        listing(5, "Genfifem", "Drozipan Peanut Butter Crunchy 500g", "Vanilla"), listing(6, "Genfifem", "Peanut Butter Crunchy 500g", "Vanilla"),
    ]
    pairs = {p for p in rows(product_pairs(same_products(spark.createDataFrame(filler + cases, LISTING), brands))) if p[1] < 100}
    assert pairs == {(1, 2), (3, 4)}


def test_profiles_with_several_gaps_merge(spark):
    whole = [("m", "a", "skyr", "mint", 100.0, 1), ("m", "b", "skyr", "mint", 200.0, 1), ("k", "c", "skyr", "mint", 200.0, 1), ("k", "c", "other tea", "mint", 300.0, 1)]
    poor = {
        (None, None, "skyr", "mint", 100.0, 1): ("m", "a", "skyr"), (None, None, None, "mint", 100.0, 1): ("m", "a", "skyr"), ("m", None, None, "mint", 200.0, 1): ("m", "b", "skyr"),
        (None, None, "skyr", "mint", 200.0, 1): (None, None, "skyr"), ("k", None, "other tea", "mint", 300.0, 1): ("k", "c", "other tea"), ("m", "a", "other pie", "mint", 100.0, 1): ("m", "a", "skyr"),
        (None, "c", None, "mint", 300.0, 1): (None, "c", None), ("m", None, "skyr", "mint", 100.0, 1): ("m", "a", "skyr"),
    }
    merged = merge_profiles(spark.createDataFrame([*whole, *poor], "maker string, line string, kind string, taste string, size double, pieces int"))
    found = {tuple(r[f"p_{c}"] for c in PROFILE): (r.m_maker, r.m_line, r.m_kind) for r in merged.collect()}
    assert found == {w: w[:3] for w in whole} | poor


def test_lines_do_not_depend_on_the_number_of_listings(spark, brands):
    lines = F.array(*map(F.lit, ("Voranis", "Ribala", "Thozantis", "Blemasor")))
    many = spark.range(24_000).select((F.col("id") + 1000).alias("listing_id"), F.lit("Killona Nutrition").alias("brand"), F.concat(lines[(F.col("id") % 4).cast("int")], F.lit(" Mass Gainer 3 kg")).alias("item_name"), F.lit("Mocha").alias("flavour"), F.lit(None).cast("double").alias("net_quantity_grams"), F.lit(T).alias("observed_at"), F.lit(T).alias("ingested_at"))
    few = [listing(i, "Genfifem", f"{name} Skyr 100 g", "Vanilla") for i, name in enumerate(("Kembulex", "Kembulex", "Kembulex", "Kembullex", "Voranis", "Vorannis", "Drozipan"), 1)]
    found = same_products(spark.createDataFrame(few, LISTING).unionByName(many), brands).where("listing_id < 100")
    assert rows(product_pairs(found)) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)]


def test_neighbours_against_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(160)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n int")
    targets = spark.createDataFrame([(w, 3) for w in words[::3]], "target string, weight int")
    want = sorted((w, t, 3, edits(w, t, 2)) for w in words for t in words[::3] if w != t and min(len(w), len(t)) >= 5 and edits(w, t, 2) <= allowed_edits(len(t)))
    assert sorted(map(tuple, near_pairs(frame, targets, 2).collect())) == want and want
    assert near_pairs(frame, targets, 3).isEmpty()


def test_representatives(spark):
    members = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (7, "a")], "listing_id long, product string")
    assert rows(representative_pairs(members)) == [(1, 1, 3), (2, 2, 1), (3, 1, 3), (7, 1, 3)]


def test_quantities_and_flavours():
    said, rest = quantity_of("Voranis 4 x 90g skyr", 0.36)
    assert (said.low, said.count) == (90.0, 4) and said.total_low < 360 < said.total_high and "90" not in rest
    assert quantity_of("Box of 6 - 0.93 kg each", None)[0].count == 6 and quantity_of("no numbers", None)[0].low is None
    assert flavour_key("Choc. Dark") == flavour_key("dark chocolate flavour") and flavour_key("Pista Kesar") == flavour_key("Saffron Pistachio") and flavour_key(" ") is None


# --- survivors -------------------------------------------------------------------------------------------------------

RECORD = "record_id long, product_id string, source_id string, evidence_observed_at string, nutrition_status string, brand string, item_name string, flavour string, net_quantity_grams double, serving_size_grams double, ingredients_raw string, calories double, protein_grams double"


def record(key, product, source="open", at="2025-01-01T00:00:00Z", status="unverified", brand="b", kcal=1.0):
    return (key, product, source, at, status, brand, None, "TBD", float("nan"), -1.0, " ", kcal, None)


def test_survivors(spark):
    sources = spark.createDataFrame([("open", 40), ("label", 90)], "source_id string, nutrition_authority int")
    data = [
        record(1, "p"), record(2, "p", " LABEL ", brand="N/A"), record(3, "p", "unlisted", at="1767225600"), record(3, "p", "unlisted", at="1767225600"),
        record(4, "q", status="Verified ", kcal=None), record(5, "q", "label"), record(6, "one"), record(7, None), record(None, "p"),
        record(8, "t"), record(9, "t", at="2025-01-01T01:00:00+02:00"), record(10, "t", at=None), record(11, "u"), record(12, "u"),
    ]
    df = spark.createDataFrame(data, RECORD).withColumn("authority", F.lit(99)).withColumn("field_name", F.lit("clash"))
    found = {(r.product_id, r.field_name): r.record_id for r in surviving_values(df, sources).collect()}
    assert found == {
        ("p", "record"): 2, ("p", "brand"): 1, ("p", "calories"): 2, ("q", "record"): 4, ("q", "brand"): 4, ("q", "calories"): 5,
        ("t", "record"): 8, ("t", "brand"): 8, ("t", "calories"): 8, ("u", "record"): 11, ("u", "brand"): 11, ("u", "calories"): 11,
    }
    assert rows(surviving_values(df.limit(0), sources)) == []


def test_observed_times(spark):
    texts = ["2025-01-01T00:00:00.000Z", "2025-01-01T02:00:00+02:00", "1735689600", "1735689600000", "2025-01-01", "2025-01-01T00:00:00", "soon", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", F.unix_seconds(observed_time(F.col("t"))).alias("s")).orderBy("i").collect()]
    assert got == [1735689600] * 6 + [None] * 3


def test_truth_discovery_trusts_the_reliable_source(spark):
    rng = random.Random(3)
    data = []
    for i in range(120):
        for source, right in (("good", 0.95), ("fair", 0.7), ("poor", 0.3), ("poor2", 0.3)):
            data.append((len(data), f"p{i}", source, None, None, f"v{i}" if rng.random() < right else f"w{rng.randint(0, 1)}", None, None, None, None, None, None, None))
    claims = claims_of(spark.createDataFrame(data, RECORD))
    truth, trust = discover_truth(claims)
    right = [r.value == "v" + r.g[1:] for r in truth.where("field = 'brand'").collect()]
    reliable = {r.src: r.reliability for r in trust.collect()}
    assert sum(right) / len(right) > 0.9 and reliable["good"] > reliable["fair"] > reliable["poor"]
    assert rows(discover_truth(claims.limit(0))[0]) == []


# --- mixing ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    docs = [(i, "word " * rng.randint(1, 60), "a" if i < 700 else "b" if i < 950 else "c") for i in range(1000)]
    docs += [(0, docs[0][1], "a"), (2000, None, "a"), (2001, "", "b"), (2002, "unlisted text", "z"), (None, "x", "a")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(5)).withColumn("rank", F.lit("clash"))


TARGET = "source string, target_share double, max_repeats int"


def test_mix_meets_its_targets(spark, corpus):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.55, 3), ("c", 0.1, 1), ("none", 0.05, 9), (None, 0.5, 1)], TARGET)
    chosen, report = mix(corpus, targets)
    total = sum(r.source_tokens for r in report.collect())
    by = {r.source: r for r in report.collect()}
    longest = 130
    for name in ("a", "b"):
        assert abs(by[name].used_tokens - by[name].target_share * total) <= longest and not by[name].short
    assert by["c"].short and by["none"].short and by["none"].used_tokens == 0
    assert by["c"].used_tokens == by["c"].source_tokens
    copies = {r.source: r.m for r in chosen.groupBy("source").agg(F.max("copies").alias("m")).collect()}
    assert copies["a"] == 1 and 2 <= copies["b"] <= 3 and copies["c"] == 1
    assert rows(short_sources(corpus, targets)) == [("c",), ("none",)]
    assert rows(chosen) == rows(mix(corpus, targets)[0])
    assert chosen.select("doc_id").distinct().count() == chosen.count()


def test_unequal_chances_favour_weighty_documents(spark, corpus):
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 3)], TARGET)
    heavy = F.when(F.col("doc") % 2 == 0, 8.0).otherwise(1.0)
    chosen = mix(corpus, targets, weight=heavy)[0].where("source = 'a'")
    even = chosen.where("doc_id % 2 = 0").count()
    assert even > 0.75 * chosen.count()


def test_mix_of_nothing(spark, corpus):
    targets = spark.createDataFrame([("a", 0.5, None)], TARGET)
    assert rows(short_sources(corpus.limit(0), targets)) == [] and rows(short_sources(corpus, targets.limit(0))) == []
    assert rows(mix(corpus, targets)[0]) == []
    assert allocate(sized_documents(corpus, targets), targets).count() == 1


# --- leaks -----------------------------------------------------------------------------------------------------------

ITEM = "Per twelve pewter cones, Rodiquille trails 692 drams of total glucose. The patient officer openly seals whatever some deputy warden weighs while no invoice stalls. For Rodiquille, how large a allowance reaches this quota although no crate cracks?"
PROSE = "We grind the oats in small lots and pack on Friday. Nothing in the bowl is fried; the rice is soaked and then baked. "


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, PROSE + ITEM + PROSE), (2, PROSE + " ".join(words[:18]).upper() + PROSE), (3, PROSE + " ".join(words[:6]) + PROSE), (4, PROSE),
        (5, PROSE + "\n".join(words[10:30])), (6, ITEM.replace("692", "17").replace("Rodiquille", "Destawend")), (7, ITEM.replace("officer openly", "offi-\ncer open-\nly")),
        (8, " ".join(w if i % 4 else "x" for i, w in enumerate(words))), (9, None), (10, ""), (None, ITEM), (1, PROSE + ITEM + PROSE), (11, PROSE * 400 + ITEM),
    ]
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (5, "An unrelated item that speaks of Destawend and of nothing which any document here would ever hold, not even once.")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("template", F.lit("clash")).withColumn("item_id", F.lit(7))
    found = {(r.doc_id, r.item_id): r for r in leaked_items(df, items).collect()}
    assert {d for d, _ in found} == {1, 2, 5, 6, 7, 11} and {i for _, i in found} == {1, 2}
    assert found[6, 1].exchanged >= 2 and found[6, 1].consistent and found[1, 1].exchanged == 0
    assert found[1, 1].held == 1.0 and found[11, 2].held == 1.0
    shuffled = leaked_items(df, items, max_item_windows=1)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == set(found)
    assert rows(leaked_items(df.limit(0), items)) == [] and rows(leaked_items(df, items.limit(0))) == []


def test_leaks_of_documents_of_numbers_only(spark):
    numbers = " ".join(str(i % 977) for i in range(20_000))
    item = "The twelve readings were 4 8 15 16 23 42 4 8 15 16 23 42 in that order of the day."
    docs = spark.createDataFrame([(1, numbers), (2, "0 " * 20_000), (3, PROSE + "4 8 15 16 23 42 4 8 15 16 23 42" + PROSE), (4, item.replace("15", "99"))], "doc_id long, text string")
    found = {r.doc_id: r for r in leaked_items(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(found) == {3, 4} and found[4].exchanged == 1 and found[4].consistent


def test_consistent_slots_show_a_reworked_copy(spark):
    item = "mix 12 g oats with 30 g milk and add 12 g honey for 7 days at 45 degrees in 18 jars"
    other = {"12": "9", "30": "31", "7": "8", "45": "44", "18": "19"}
    same = " ".join(other.get(w, w) for w in item.split())
    mixed = same[::-1].replace("9", "6", 2)[::-1]  # the second 9 and the 19 differ
    df = spark.createDataFrame([(1, same), (2, mixed), (3, item)], "doc_id long, text string")
    found = {r.doc_id: r for r in leaked_items(df, spark.createDataFrame([(1, item)], "item_id long, text string"), share=0.8).collect()}
    assert set(found) == {1, 3} and found[1].reworked and found[1].exchanged == 6 and not found[3].reworked


# --- spam ------------------------------------------------------------------------------------------------------------


def prose(rng):
    things, places = ["oats", "rice", "honey", "whey", "soy", "milk", "cocoa", "dates", "sesame", "lentils"], ["the fridge", "a dry tin", "the gym bag", "the cupboard", "the shelf"]
    forms = [
        "We grind the {a} in small lots of {n} kg and pack it before noon.", "The bar is made with {a}, {b} and a little {c}.", "Keep it in {p} and use it within {n} days.",
        "Has anyone tried it with {a}?", "I keep {a} in {p} because it lasts longer than {b}.", "In the morning she likes {a} with warm {b}.", "Each pack gives {n} g of protein and a taste of {a}.",
    ]
    return " ".join(rng.choice(forms).format(a=rng.choice(things), b=rng.choice(things), c=rng.choice(things), n=rng.randint(2, 99), p=rng.choice(places)) for _ in range(rng.randint(6, 12)))


def test_spam_pages(spark):
    rng = random.Random(11)
    good = [(i, prose(rng)) for i in range(300)]
    keys = ["cheap whey shop", "buy protein bar", "online whey deal", "best bar price"]
    spam = {
        1000: ", ".join(rng.choice(keys) for _ in range(60)), 1001: " ".join("#" + rng.choice(keys).replace(" ", "") for _ in range(60)),
        1002: " ".join(f'<a href="//x-{i}.example/{i}">{rng.choice(keys)}</a>' for i in range(40)), 1003: "\n".join(f"Ribala bar {i}00g Rs {i}55 SALE" for i in range(1, 40)),
        1004: " ".join(f"Looking for {k}? The {k} from our {k} shop is real {k}." for k in keys * 4), 1005: prose(rng) + "\n" + ", ".join(rng.choice(keys) for _ in range(120)),
    }
    fine = {2000: prose(rng) + " See https://x.example/a " + prose(rng), 2001: prose(rng) + "\nTags: oats, whey", 2002: "", 2003: " \n ", 2004: None}
    data = good + list(spam.items()) + list(fine.items()) + [(None, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("surprise", F.lit("clash")).withColumn("chars", F.lit(1))
    found = {r.doc_id for r in spam_pages(df).collect()}
    assert set(spam) <= found
    assert not found & set(fine) and len(found - set(spam)) <= 3
    assert rows(spam_pages(df.limit(0))) == []


def test_pieces_cover_the_text_and_the_model_is_bounded():
    rng = random.Random(2)
    text = prose(rng) + "\n\n" + "a, " * 5_000
    tokens = classes_of(text)
    assert [t for p in pieces_of(tokens) for t in p] == tokens
    assert all(a[2] <= b[1] for a, b in zip(tokens, tokens[1:]))
    model = Model({(NUMBER["<s>"], NUMBER["the"]): 3, (NUMBER["the"], NUMBER["word0"]): 3})
    assert model.surprise[NUMBER["the"], NUMBER["word0"]] < model.surprise[NUMBER["the"], NUMBER["tag"]] < 20
    assert model.surprise.shape == (len(NAMES), len(NAMES)) and len(NAMES) < 1_000


def test_smoothing_stays_within_a_document():
    frame = pd.DataFrame({"doc": [1, 2, 3], "sizes": [[2, 1], [], [1]], "chars": [[5, 3], [], [4]], "codes": [np.array([NUMBER["the"], NUMBER["word0"], NUMBER["tag"]], np.uint16).tobytes(), b"", np.array([NUMBER["tag"]], np.uint16).tobytes()]})
    batch, model = Batch(frame), Model({(NUMBER["<s>"], NUMBER["the"]): 3, (NUMBER["the"], NUMBER["word0"]): 3})
    start = NUMBER["<s>"]
    words = model.surprise[start, NUMBER["the"]] + model.surprise[NUMBER["the"], NUMBER["word0"]]
    tag = model.surprise[start, NUMBER["tag"]]
    assert model.smoothed(batch) == pytest.approx([(words + tag) / 3, (words + tag) / 3, tag])
    assert list(batch.docs) == [1, 1, 3] and list(batch.prose()) == [True, True, True]


def test_registered_mix_draws_by_size(spark, tmp_path):
    data = [(i, "a", "word " * (3 if i % 2 else 60)) for i in range(400)] + [(1000, "a", "word " * 600), (1001, "a", "")]
    spark.createDataFrame(data, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    chosen = {r.doc_id for r in QUERIES["p9_mix"](spark, str(tmp_path)).collect()}
    long, short = len([d for d in chosen if d < 400 and d % 2 == 0]), len([d for d in chosen if d < 400 and d % 2])
    assert 1000 in chosen and 1001 not in chosen and long > 5 * short > 0
