"""Quantities recorded in different units, scales and bases, in one common unit.

Every writing of a unit ('GM', 'kilo', 'fl. oz') is treated as a source of its own. Sources are linked where they give
the same entity: the quantity that one text prints twice, and the typical amount of one nutrient. ``pairwise_scales``
estimates a robust scale and offset for each linked pair and snaps the scale to a known conversion; ``propagate``
carries the conversions from g, ml and kcal through the graph of sources. ``common_amounts`` converts each stated
quantity with the factor that its own writing got there, checked against the table of known conversions, which also
gives the factors of writings that nothing links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import broadcast_if_small, cut_lineage, latest_by

# Known conversions into thousandths of the common unit (g, ml, kcal), and how the units are written.
_G, _ML, _KCAL = "g", "ml", "kcal"
CONVERSIONS = {
    "ug": (_G, 0.001, ("µg", "μg", "ug", "mcg", "microgram", "micrograms")),
    "mg": (_G, 1.0, ("mg", "mgs", "milligram", "milligrams")),
    "g": (_G, 1000.0, ("g", "gm", "gms", "gr", "gram", "grams", "gramme", "grammes")),
    "kg": (_G, 1000000.0, ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms")),
    "oz": (_G, 28349.523125, ("oz", "ozs", "ounce", "ounces")),
    "lb": (_G, 453592.37, ("lb", "lbs", "pound", "pounds")),
    "ml": (_ML, 1000.0, ("ml", "mls", "millilitre", "millilitres", "milliliter", "milliliters")),
    "cl": (_ML, 10000.0, ("cl", "cls", "centilitre", "centilitres", "centiliter", "centiliters")),
    "dl": (_ML, 100000.0, ("dl", "dls", "decilitre", "decilitres", "deciliter", "deciliters")),
    "l": (_ML, 1000000.0, ("l", "lt", "ltr", "ltrs", "litre", "litres", "liter", "liters")),
    "floz": (_ML, 29573.5295625, ("floz", "fluidounce", "fluidounces")),
    "kcal": (_KCAL, 1000.0, ("kcal", "kcals", "cal", "cals", "calorie", "calories", "kilocalorie", "kilocalories")),
    "kj": (_KCAL, 1000.0 / 4.184, ("kj", "kjs", "kilojoule", "kilojoules")),
}
IMPERIAL = ("oz", "lb", "floz")
_WRITINGS = {w: unit for unit, (_, _, writings) in CONVERSIONS.items() for w in writings}
_FRACTIONS = {"½": ".5", "¼": ".25", "¾": ".75"}
# Devanagari, Arabic-Indic, extended Arabic-Indic, Bengali and full-width digits
_DIGITS = "".join(chr(first + i) for first in (0x966, 0x660, 0x6F0, 0x9E6, 0xFF10) for i in range(10))
_WORDS = {"half": "0.5", "quarter": "0.25"}

_NUMBER = r"\d(?:[\d.,]*\d)?"  # no repeated group: those recurse, and long runs of digits would overflow the stack
_UNIT = "fl\\.?\\s*oz|fluid\\s+ounces?|" + "|".join(sorted(_WRITINGS, key=lambda w: (-len(w), w)))
# fixed values: a number before its unit, a unit before its number, a pack count
_ANY = rf"(?<![\d.,])({_NUMBER})\s*(fl\.? ?oz|(?!x\b)[a-zµμ]+)"
_PAIR = rf"(?<![\d.,])({_NUMBER})\s*({_UNIT})(?![a-zµμ])"
_TURNED = rf"(?<![a-zµμ])({_UNIT})\s*({_NUMBER})(?![\d.,]*\s*(?:{_UNIT})(?![a-zµμ]))"
_TIMES = r"(?<![\d.,])(\d+)\s*[x×*]\s*(?=\d)"
_TIMES_AFTER = r"[x×*]\s*(\d+)(?![\d.,])"


def spelled(unit: Column) -> Column:
    """A unit's writing without case, dots and white space."""
    return F.regexp_replace(F.lower(unit), "[.\\s\u00a0]+", "")


def _plain(text: Column) -> Column:
    """Lower case, with fractions and the words half and quarter as decimal numbers."""
    low = F.regexp_replace(F.lower(text), "[\\s\u00a0\u200b\ufeff]+", " ")
    low = F.translate(low, _DIGITS, "0123456789" * (len(_DIGITS) // 10))
    for sign, decimal in _FRACTIONS.items():
        low = F.regexp_replace(low, rf"(\d)\s*{sign}", rf"$1{decimal}")
        low = F.regexp_replace(low, sign, f"0{decimal}")
    for word, decimal in _WORDS.items():
        low = F.regexp_replace(low, rf"\b{word}(?: an?)?\b", decimal)
    return low


def number_of(text: Column) -> Column:
    """A printed number: a comma before exactly three digits groups thousands, any other is a decimal comma."""
    grouped = F.regexp_replace(text, r",(?=\d{3}(?!\d))", "")
    return F.regexp_replace(grouped, ",", ".").try_cast("double")


def _pairs_in(plain: Column, pattern: str, number: int, unit: int) -> Column:
    numbers, units = F.regexp_extract_all(plain, F.lit(pattern), F.lit(number)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(unit))
    return F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda p: F.struct(number_of(p["n"]).alias("number"), spelled(p["u"]).alias("writing")))


def printed(plain: Column) -> Column:
    """All quantities of a plain text, as an array of (number, writing), in order; if there are none, those written unit first ('cl 33')."""
    straight = _pairs_in(plain, _PAIR, 1, 2)
    return F.when(F.size(straight) > 0, straight).otherwise(_pairs_in(plain, _TURNED, 2, 1))


def packs(plain: Column) -> Column:
    """How many units of the printed size a pack has; 1 if the plain text doesn't say."""
    count = F.coalesce(*[F.nullif(F.regexp_extract(plain, p, 1), F.lit("")).try_cast("double") for p in (_TIMES, _TIMES_AFTER)], F.lit(1.0))
    return F.when(count > 0, count).otherwise(F.lit(1.0))


def observations(texts: DataFrame) -> DataFrame:
    """entity, source, number, hub: what each text (entity, text) prints, whatever its words, once per writing, if it prints two or more.

    The hub, which the others are paired with, is the first quantity in a known unit, else the first.
    """
    plain = _plain(F.col("text"))
    numbers, words = (F.regexp_extract_all(plain, F.lit(_ANY), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.transform(F.arrays_zip(numbers.alias("n"), words.alias("u")), lambda p: F.struct(spelled(p["u"]).alias("source"), number_of(p["n"]).alias("number"))), lambda p: p["number"] > 0)
    said = texts.select("entity", pairs.alias("p")).where(F.size("p") > 1).select("entity", F.posexplode("p").alias("at", "p")).select("entity", "at", "p.*")
    once = said.groupBy("entity", "source").agg(F.min(F.struct("at", "number")).alias("m")).select("entity", "source", "m.at", "m.number")
    return _with_hub(once, F.when(F.col("source").isin(*_WRITINGS), F.col("at")).otherwise(F.col("at") + 1_000_000_000))


def typical(values: DataFrame) -> DataFrame:
    """entity, source, number, hub: the median of what each source says of an entity such as a nutrient (entity, source, number)."""
    once = values.where(F.col("number") > 0).groupBy("entity", "source").agg(F.percentile_approx("number", 0.5, 10_000).alias("number"), F.count("*").alias("n"))
    return _with_hub(once.select("entity", "source", "number", "n"), F.struct(F.when(F.col("source").isin(_G, _ML, _KCAL), 0).otherwise(1), -F.col("n"), "source"))


def _with_hub(once: DataFrame, rank: Column) -> DataFrame:
    first = once.groupBy("entity").agg(F.min_by("source", rank).alias("first"), F.count("*").alias("sources")).where(F.col("sources") > 1)
    return once.join(first, "entity").select("entity", "source", "number", (F.col("source") == F.col("first")).alias("hub"))


def pairwise_scales(observed: DataFrame, *, tolerance: float = 0.03, least: int = 3) -> DataFrame:
    """Scale and offset between each two sources that give the same entities, and the known conversion it snaps to.

    ``observed`` has entity, source, number and hub; each source is paired with its entity's hub, so the pairs are no
    more than the rows, and every pair is given in both directions. The scale is the median ratio of what the two
    sources say; the offset is that of the least-squares line, 0 if small. A pair with fewer than ``least``
    entities, with an offset, with ratios whose middle half spreads over more than twice ``tolerance`` (so measures
    such as a cup are none), or farther than ``tolerance`` (log ratio) from every known ratio has a null ``known``; where a source is a known writing, only ratios of its own kind and size count.
    """
    a = observed.where("hub").select("entity", F.col("source").alias("source_a"), F.col("number").alias("a"))
    b = observed.where("NOT hub").select("entity", F.col("source").alias("source_b"), F.col("number").alias("b"))
    met = a.join(b, "entity")
    turned = F.col("source_a") > F.col("source_b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    met = met.select(pick("source_a", "source_b").alias("source_a"), pick("source_b", "source_a").alias("source_b"), pick("a", "b").alias("a"), pick("b", "a").alias("b"))
    pairs = cut_lineage(
        met.groupBy("source_a", "source_b").agg(
            F.count("*").alias("entities"),
            F.percentile_approx(F.log(F.col("b") / F.col("a")), [0.25, 0.5, 0.75], 10_000).alias("q"),
            F.percentile_approx("a", 0.5, 10_000).alias("typical_a"), F.percentile_approx("b", 0.5, 10_000).alias("typical_b"),
            F.regr_intercept("b", "a").alias("above_b"), F.regr_intercept("a", "b").alias("above_a"),
        ).withColumn("scale", F.exp(F.col("q")[1])).withColumn("spread", F.col("q")[2] - F.col("q")[0])
    )
    both = pairs.select("source_a", "source_b", "entities", "scale", "spread", F.col("typical_b").alias("typical"), F.col("above_b").alias("intercept")).unionByName(
        pairs.select(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "entities", (1 / F.col("scale")).alias("scale"), "spread", F.col("typical_a").alias("typical"), F.col("above_a").alias("intercept"))
    )
    table = _table()
    known_a, known_b = F.try_element_at(table, F.col("source_a")), F.try_element_at(table, F.col("source_b"))
    all_units = [(kind, factor) for kind, factor, _ in CONVERSIONS.values()]
    entry = lambda k, r: F.struct(F.lit(k).alias("kind"), F.lit(float(r)).alias("ratio"))
    units = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(f)).alias("factor")) for k, f in all_units])
    free = F.array(*[entry(k, r) for k, r in sorted({(ka, fa / fb) for ka, fa in all_units for kb, fb in all_units if ka == kb})])
    of_kind = lambda k: F.filter(units, lambda u: u["kind"] == k)
    made = lambda kind, ratio: F.struct(kind.alias("kind"), ratio.alias("ratio"))
    ratios = (
        F.when(known_a.isNotNull() & known_b.isNotNull(), F.when(known_a["kind"] == known_b["kind"], F.array(made(known_a["kind"], known_a["factor"] / known_b["factor"]))))
        .when(known_a.isNotNull(), F.transform(of_kind(known_a["kind"]), lambda u: made(u["kind"], known_a["factor"] / u["factor"])))
        .when(known_b.isNotNull(), F.transform(of_kind(known_b["kind"]), lambda u: made(u["kind"], u["factor"] / known_b["factor"])))
        .otherwise(free)
    )
    nearest = F.array_min(F.transform(ratios, lambda r: F.struct(F.abs(F.log(F.col("scale") / r["ratio"])).alias("far"), r["ratio"].alias("ratio"))))
    offset = F.when(F.abs(F.coalesce("intercept", F.lit(0.0))) < tolerance * F.col("typical"), F.lit(0.0)).otherwise(F.col("intercept"))
    # the offset of a handful of rounded numbers says little: it counts from ten entities on
    shifted = (F.col("entities") >= 10) & (offset != 0)
    steady = F.col("spread") <= 2 * tolerance
    known = F.when((F.col("entities") >= least) & (nearest["far"] <= tolerance) & steady & ~shifted, nearest["ratio"])
    return both.select("source_a", "source_b", "entities", "scale", offset.alias("offset"), known.alias("known"))


def propagate(scales: DataFrame, seeds: DataFrame) -> DataFrame:
    """Factors (source, kind, factor) carried from ``seeds`` along the snapped pairs until no further source is reached.

    A source that several paths reach gets the factor of the nearest seed (ties: that of most entities, then the
    smallest). Seeds keep their own.
    """
    edges = cut_lineage(scales.where(F.col("known").isNotNull()).select("source_a", "source_b", "entities", "known"))
    reached = cut_lineage(seeds.select("source", "kind", "factor"))
    while True:
        new = (
            reached.join(edges, F.col("source") == F.col("source_a"))
            .select(F.col("source_b").alias("source"), "kind", (F.col("factor") / F.col("known")).alias("factor"), "entities")
            .join(reached.select("source"), "source", "left_anti")
        )
        best = cut_lineage(new.groupBy("source").agg(F.max(F.struct("entities", -F.col("factor"), "kind", "factor")).alias("m")).select("source", "m.kind", "m.factor"))
        if best.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(best))


def seeds(spark: SparkSession) -> DataFrame:
    """The known writings as (source, kind, factor)."""
    rows = [(w, kind, factor) for kind, factor, writings in CONVERSIONS.values() for w in writings]
    return spark.createDataFrame(rows, "source string, kind string, factor double")


def _table() -> Column:
    """The known conversions: writing to (kind, factor)."""
    return F.create_map(*[x for w, unit in _WRITINGS.items() for x in (F.lit(w), F.struct(F.lit(CONVERSIONS[unit][0]).alias("kind"), F.lit(float(CONVERSIONS[unit][1])).alias("factor")))])


def source_factors(printed_twice: DataFrame, typical_amounts: DataFrame, *, tolerance: float = 0.03, loose: float = 0.25, least: int = 3) -> DataFrame:
    """(source, kind, factor, origin) of all writings that the graph reaches from g, ml and kcal, and of the other known ones.

    origin is 'graph' for a factor from the graph, which for a known writing must agree with the table; 'table' for a
    known writing that nothing links; 'contradicted' for one whose links say otherwise, which keeps the table's.
    Typical amounts differ by chance and so are snapped within ``loose``, and only link known writings.
    """
    spark = printed_twice.sparkSession
    exact = pairwise_scales(printed_twice, tolerance=tolerance, least=least)
    rough = pairwise_scales(typical_amounts, tolerance=loose, least=least).where(F.col("source_a").isin(*_WRITINGS) & F.col("source_b").isin(*_WRITINGS))
    table = F.broadcast(seeds(spark).select("source", F.col("kind").alias("table_kind"), F.col("factor").alias("table_factor")))
    base = seeds(spark).where(F.col("source").isin(_G, _ML, _KCAL))
    reached = propagate(exact.unionByName(rough), base)
    both = reached.join(table, "source", "full_outer")
    agrees = (F.col("kind") == F.col("table_kind")) & (F.abs(F.col("factor") / F.col("table_factor") - 1) < 1e-6)
    origin = F.when(F.col("kind").isNull(), "table").when(F.col("table_kind").isNull() | agrees, "graph").otherwise("contradicted")
    return cut_lineage(both.select("source", F.coalesce("table_kind", "kind").alias("kind"), F.coalesce("table_factor", "factor").alias("factor"), origin.alias("origin")))


def parsed(rows: DataFrame, text: str, number: Column, unit: str) -> DataFrame:
    """Adds what a text, else a number, states: _best (number, writing), _packs, _value and _column (the unit column's writing).

    Metric quantities in the text outrank imperial ones; a unit beside the number outranks the unit column. Each
    step is a column of its own, so that no pattern is matched twice.
    """
    imperial = F.array(*[F.lit(w) for w, u in _WRITINGS.items() if u in IMPERIAL])
    bare = rf"^[^a-z\d]*(?:ca|approx|about)?[^a-z\d]*({_NUMBER})(?:\s*[x×*].*|[^a-z\d]*)$"
    metric = F.filter("_pairs", lambda p: ~F.array_contains(imperial, p["writing"]))
    return (
        rows.withColumn("_plain", _plain(F.col(text)))
        .withColumn("_pairs", _pairs_in(F.col("_plain"), _PAIR, 1, 2))
        .withColumn("_pairs", F.when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(_pairs_in(F.col("_plain"), _TURNED, 2, 1)))
        .withColumn("_best", F.coalesce(F.try_element_at(metric, F.lit(1)), F.try_element_at("_pairs", F.lit(1))))
        .withColumn("_packs", F.when(F.col("_plain").isNotNull(), packs(F.col("_plain"))))
        .withColumn("_bare", F.when(F.col("_best").isNull(), number_of(F.nullif(F.regexp_extract("_plain", bare, 1), F.lit(""))) * F.col("_packs")))
        .withColumn("_column", F.when(F.col("_best").isNull(), spelled(F.col(unit))))
        .withColumn("_value", F.coalesce("_bare", F.when(~F.isnan(number), number)))
        .drop("_plain", "_pairs", "_bare")
    )


def stated(bare_kind: Column, factors: Column) -> Column:
    """(kind, amount) in thousandths of g, ml or kcal of ``parsed`` columns; a number without any unit is in ``bare_kind``.

    ``factors`` maps the known writings to (kind, factor). Null if nothing is stated, or in an unknown unit.
    """
    no_unit = F.when(F.coalesce(F.col("_column"), F.lit("")) == "", F.lit(True))
    beside, column = F.try_element_at(factors, F.col("_best.writing")), F.try_element_at(factors, F.col("_column"))
    with_unit = F.struct(beside["kind"].alias("kind"), (F.col("_best.number") * beside["factor"] * F.col("_packs")).alias("amount"))
    by_column = F.struct(F.coalesce(column["kind"], F.when(no_unit, bare_kind)).alias("kind"), (F.col("_value") * F.coalesce(column["factor"], F.when(no_unit, F.lit(1000.0)))).alias("amount"))
    return F.when(F.col("_best.number").isNotNull(), with_unit).when(F.col("_value").isNotNull(), by_column)


def learned(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(entity, kind, amount) of texts (entity, text) whose only units are writings that ``factors`` has learned."""
    plain = F.col("plain")
    found = rows.select("entity", _plain(F.col("text")).alias("plain")).where(F.size(printed(plain)) == 0).select(
        "entity",
        number_of(F.regexp_extract(plain, _ANY, 1)).alias("number"),
        spelled(F.regexp_extract(plain, _ANY, 2)).alias("source"),
        packs(plain).alias("packs"),
    )
    return found.join(factors, "source").select("entity", "kind", (F.col("number") * F.col("packs") * F.col("factor")).alias("amount"))


def _half_up(amount: Column) -> Column:
    """Rounded half up; the small term makes up for a tie that binary fractions put just below."""
    return F.floor(amount + 0.5 + 1e-9 + amount * 1e-13).cast("long")


_MOST = 9e15  # thousandths that a double still holds exactly

# How the basis of a nutrient value is written.
_PER_100 = r"^(?:per|/)?100(?:g|gm|gms|grams?|ml)$"
_PER_SERVING = r"^(?:per)?(?:serving|portion|serve)s?$"


def common_amounts(
    labels: DataFrame,
    nutrients: DataFrame,
    *,
    label_id: str = "label_id",
    value_id: str = "value_id",
    observed: str = "observed_at",
    tolerance: float = 0.03,
    least: int = 3,
) -> DataFrame:
    """Each stated pack quantity, serving size and nutrient in one common unit, in thousandths rounded half up.

    Reads net_quantity_* and serving_size_* (grams, unit, text) of the labels and label_id, nutrient_code, quantity,
    unit and basis of the nutrient values. Returns record_kind, record_id, unit, amount.

    Defined cases: a text outranks its number column unless it states no quantity; nulls, blanks, NaN, negative
    numbers, amounts above 9e15 thousandths and unknown units state nothing; an unknown basis, or a value per serving of a label without a serving
    size above 0, gives no row; a nutrient in a unit of the wrong kind gives none; rows delivered again count once
    (the last observed of one id); null ids give none; other columns are ignored.
    """
    long, values, factors = _parsed_and_factors(labels, nutrients, label_id, value_id, observed, tolerance, least)
    # the factors of known writings (no more than the table has) go along with the expression, learned ones by a join
    rows = factors.where(F.col("source").isin(*_WRITINGS)).collect()
    known = F.create_map(*[x for r in rows for x in (F.lit(r.source), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.factor).alias("factor")))])
    long = cut_lineage(long.withColumn("s", stated(F.lit(_G), known)).select("label", "record_kind", "text", "s"))
    entity = F.struct("label", "record_kind").alias("entity")
    news = broadcast_if_small(factors.where(~F.col("source").isin(*_WRITINGS)).select("source", "kind", "factor"))
    taught = learned(long.where(F.col("s").isNull() & F.col("text").isNotNull()).select(entity, "text"), news)
    amounts = (
        long.where(F.col("s.amount").between(0, _MOST)).select("label", "record_kind", F.col("s.kind").alias("unit"), F.col("s.amount").alias("exact"))
        .unionByName(taught.select("entity.label", "entity.record_kind", F.col("kind").alias("unit"), F.col("amount").alias("exact")).where(F.col("exact").between(0, _MOST)))
        .where(F.col("unit").isin(_G, _ML))
    )
    values = cut_lineage(values.withColumn("s", stated(F.col("common"), known)).select("value", "label", "common", "per", "s"))
    values = values.where((F.col("s.kind") == F.col("common")) & F.col("s.amount").between(0, _MOST))
    sizes = amounts.where((F.col("record_kind") == "serving") & (F.col("exact") > 0)).select("label", F.col("exact").alias("size"))
    per_serving = values.where(F.col("per") == "serving").join(sizes, "label").select("value", "common", (F.col("s.amount") * 100_000.0 / F.col("size")).alias("exact"))
    per_100 = values.where(F.col("per") == "100").select("value", "common", F.col("s.amount").alias("exact"))
    facts = per_100.unionByName(per_serving).select(F.lit("nutrient").alias("record_kind"), F.col("value").alias("record_id"), F.col("common").alias("unit"), "exact")
    rows = amounts.select("record_kind", F.col("label").alias("record_id"), "unit", "exact").unionByName(facts)
    return rows.select("record_kind", "record_id", "unit", _half_up(F.col("exact")).alias("amount"))


def _parsed_and_factors(labels: DataFrame, nutrients: DataFrame, label_id: str, value_id: str, observed: str, tolerance: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed label quantities, parsed nutrient values with a known basis, and the factors that both teach."""
    parts = ["net_quantity_grams", "net_quantity_unit", "net_quantity_text", "serving_size_grams", "serving_size_unit", "serving_size_text"]
    once = latest_by(labels.select(F.col(label_id).alias("label"), F.col(observed).alias("at"), *parts).where(F.col("label").isNotNull()), ["label"], ["at"])
    long = once.select(
        "label",
        F.inline(F.array(*[F.struct(F.lit(kind).alias("record_kind"), F.col(f"{name}_text").alias("text"), F.col(f"{name}_grams").alias("number"), F.col(f"{name}_unit").alias("unit_column")) for kind, name in (("net", "net_quantity"), ("serving", "serving_size"))])),
    )
    long = cut_lineage(parsed(long, "text", F.col("number"), "unit_column"))
    values = latest_by(
        nutrients.select(F.col(value_id).alias("value"), F.col(observed).alias("at"), F.col(label_id).alias("label"), "nutrient_code", "quantity", "unit", "basis").where(F.col("value").isNotNull()),
        ["value"],
        ["at"],
    )
    basis = F.regexp_replace(F.lower("basis"), r"[\s_\-.]+", "")
    energy = F.lower(F.trim("nutrient_code")).isin("energy", "energy_kcal", "energy_kj", "calories")
    common = F.when(energy, F.lit(_KCAL)).otherwise(F.lit(_G))
    per = F.when(basis.rlike(_PER_100), F.lit("100")).when(basis.rlike(_PER_SERVING), F.lit("serving"))
    values = values.select("value", "label", F.lower(F.trim("nutrient_code")).alias("code"), common.alias("common"), "quantity", "unit", per.alias("per")).where(F.col("per").isNotNull())
    values = cut_lineage(parsed(values, "quantity", F.lit(None).cast("double"), "unit").drop("quantity", "unit"))
    said = F.coalesce("_best.writing", "_column").alias("source"), F.coalesce(F.col("_best.number"), F.col("_value")).alias("number")
    codes = values.select(F.struct("code", "per").alias("entity"), *said).where(F.coalesce("source", F.lit("")) != "")
    printed_twice = observations(long.where(F.col("text").isNotNull()).select(F.struct("label", "record_kind").alias("entity"), "text"))
    return long, values, source_factors(printed_twice, typical(codes), tolerance=tolerance, least=least)


def learned_factors(labels: DataFrame, nutrients: DataFrame, *, label_id: str = "label_id", value_id: str = "value_id", observed: str = "observed_at", tolerance: float = 0.03, least: int = 3) -> DataFrame:
    """(source, kind, factor, origin) of the writings of units, as ``common_amounts`` uses them."""
    return _parsed_and_factors(labels, nutrients, label_id, value_id, observed, tolerance, least)[2]
