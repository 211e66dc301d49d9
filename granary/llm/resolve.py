"""Listings that describe the same product, by generic merge resolution.

Each listing is cut into words, the words are looked up in a dictionary learned from all listings, and with its own
part of the dictionary each listing is read into a profile of six attributes. Equal profiles merge. Profiles that lack
brand, line or type are blocked on what they say and merge with the richer profiles that agree with it, if these agree
in what is lacking; profiles made richer are blocked and matched again, until none changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.canonical import CanonicalList
from granary.llm.listings import BRAND, FLAVOUR, JOINED, PLAIN, WORD, Cut, Entries, Meaning, Quantity, cut_listing, looked_up, read
from granary.llm.vocabulary import learn_dictionary, mark_companions
from granary.session import broadcast_if_small, cut_lineage, latest_by

PROFILE = ["maker", "line", "kind", "taste", "size", "pieces"]
_CUT = "id long, title array<string>, brand array<string>, flavour array<string>, taste string, field string, looked array<string>, low double, high double, exact boolean, pieces int, total_low double, total_high double"
_READ = "id long, maker string, line string, kind string, taste string, own string"
_SIZES = ["low", "high", "exact", "pieces", "total_low", "total_high"]


def cut_listings(listings: DataFrame) -> DataFrame:
    """Words, quantities and what is to be looked up (role, then text) of each listing; the one pass over the texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, brand, title, flavour, net in zip(batch["id"], batch["brand"], batch["title"], batch["flavour"], batch["net"]):
                c = cut_listing(brand, title, flavour, None if net is None or net != net else float(net))
                looked = [role + text for role, text in looked_up(c)]
                if brand and brand.strip():
                    looked.append(BRAND + brand)
                s = c.said
                rows.append((key, c.title, c.brand, c.flavour, c.taste, brand, looked, s.low, s.high, s.exact, s.count, s.total_low, s.total_high))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _CUT.split(", ")])
            yield frame.astype({"pieces": "Int32", "exact": "bool", "low": "float64", "high": "float64", "total_low": "float64", "total_high": "float64"})

    made = listings.select("id", "brand", "title", "flavour", "net").mapInPandas(cut, _CUT)
    return cut_lineage(made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high", "total_low", "total_high")}))


def _looked(cut: DataFrame) -> DataFrame:
    each = cut.select("id", "taste", F.explode("looked").alias("both"))
    return each.select("id", "taste", F.left("both", F.lit(1)).alias("role"), F.substring("both", 2, 2**31 - 1).alias("text"))


def count_texts(cut: DataFrame) -> DataFrame:
    """(role, text, own, n): how many listings have each word, pair, brand field and said flavour; counted in each task first."""
    own = (F.col("role") == FLAVOUR) & (F.col("text") == F.col("taste"))
    each = _looked(cut).withColumn("own", F.coalesce(own, F.lit(False))).where((F.col("role") != FLAVOUR) | F.col("own")).select("role", "text", "own")
    plain = cut.select(F.explode(F.array_distinct("title")).alias("text")).where(F.col("text").isin(*sorted(PLAIN))).select(F.lit(WORD).alias("role"), "text", F.lit(False).alias("own"))
    return cut_lineage(each.unionByName(plain).groupBy("role", "text", "own").agg(F.count("*").alias("n")))


def read_profiles(cut: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id and the six attributes of each listing, and its own words in case no line is found; what isn't said is null.

    Each listing gets its own entries of the dictionary by a join on the texts it looks up, so the dictionary is
    never held whole by a task unless it is small.
    """
    met = _looked(cut).select("id", "role", "text").join(broadcast_if_small(dictionary, 200_000), ["role", "text"])
    entry = F.concat_ws("\t", "role", "text", F.coalesce("line", F.lit("")), F.coalesce("maker", F.lit("")), F.coalesce("flavour", F.lit("")), F.coalesce("spelled", F.lit("")), F.col("explained").cast("int").cast("string"), F.col("vague").cast("int").cast("string"), F.col("weight").cast("string"))
    held = met.groupBy("id").agg(F.collect_list(F.when(F.col("role") == BRAND, F.concat_ws("\t", F.lit(BRAND), "maker")).otherwise(entry)).alias("entries"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, title, brand, flavour, taste, entries in zip(batch["id"], batch["title"], batch["brand"], batch["flavour"], batch["taste"], batch["entries"]):
                known, maker = Entries({}, {}, {}), None
                for told in () if entries is None else entries:
                    parts = told.split("\t")
                    if parts[0] == BRAND:
                        maker = parts[1]
                    elif parts[0] == FLAVOUR:
                        known.flavours[parts[1]] = parts[4]
                    else:
                        meaning = Meaning(parts[2] or None, parts[3] or None, parts[4] or None, parts[5] or None, parts[6] == "1", parts[7] == "1", int(parts[8]))
                        (known.words if parts[0] == WORD else known.joined)[parts[1]] = meaning
                rows.append((key, *read(Cut(list(title), list(brand), list(flavour), taste, Quantity()), maker, known)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])

    words = cut.join(held, "id", "left").select("id", "title", "brand", "flavour", "taste", "entries").mapInPandas(look, _READ)
    said = cut_lineage(words.join(cut.select("id", *_SIZES), "id"))
    # sizes of a type that at least one in a hundred of its exact statements has, and its pack counts likewise
    stated = said.where(F.col("exact") & F.col("kind").isNotNull()).groupBy("kind", F.round("low", 3).alias("size")).count()
    packed = said.where(F.col("pieces").isNotNull() & F.col("kind").isNotNull()).groupBy("kind", "pieces").count()
    usual = _usual(stated, "size", "sizes").join(_usual(packed, "pieces", "packs"), "kind", "left")
    said = said.join(broadcast_if_small(usual), "kind", "left")
    sizes, packs = F.coalesce("sizes", F.array().cast("array<double>")), F.coalesce("packs", F.array().cast("array<int>"))
    total = (F.col("total_low") + F.col("total_high")) / 2
    unit_said = _nearest_size(F.col("low"), F.col("high"), sizes)
    by_ratio = F.greatest(F.round(total / unit_said), F.lit(1.0)).cast("int")
    pieces = F.coalesce("pieces", F.when(F.col("low").isNotNull() & total.isNotNull() & (F.abs(total / unit_said / by_ratio - 1) < 0.05), by_ratio))
    unit_by_count = _nearest_size(F.col("total_low") / F.col("pieces"), F.col("total_high") / F.col("pieces"), sizes)
    whole = _nearest_size(F.col("total_low"), F.col("total_high"), sizes)
    multiples = F.filter(
        F.flatten(F.transform(packs, lambda p: F.transform(sizes, lambda s: F.struct(s.alias("size"), p.alias("pieces"))))),
        lambda m: (m["size"] * m["pieces"]).between(F.col("total_low"), F.col("total_high")),
    )
    split = F.when(F.array_contains(sizes, whole) | (F.size(multiples) != 1), F.struct(whole.alias("size"), F.lit(1).alias("pieces"))).otherwise(multiples[0])
    size = F.when(F.col("low").isNotNull(), unit_said).when(F.col("pieces").isNotNull(), unit_by_count).when(total.isNotNull(), split["size"])
    count = F.when(F.col("low").isNotNull(), F.coalesce(pieces, F.lit(1))).when(F.col("pieces").isNotNull(), F.col("pieces")).when(total.isNotNull(), split["pieces"])
    return said.select("id", "maker", "line", "kind", "taste", "own", F.round(size, 1).alias("size"), count.cast("int").alias("pieces"))


def _nearest_size(low: Column, high: Column, sizes: Column) -> Column:
    """The known size nearest to the middle of a range, among those in it; the middle itself if none is."""
    middle = (low + high) / 2
    inside = F.filter(sizes, lambda s: (s >= low - 1e-6) & (s <= high + 1e-6))
    best = F.array_min(F.transform(inside, lambda s: F.struct(F.abs(s - middle).alias("far"), s.alias("size"))))["size"]
    return F.coalesce(best, middle)


def _usual(counted: DataFrame, column: str, name: str, share: float = 0.01) -> DataFrame:
    whole = counted.groupBy("kind").agg(F.sum("count").alias("all"))
    return counted.join(whole, "kind").where(F.col("count") >= share * F.col("all")).groupBy("kind").agg(F.array_sort(F.collect_set(column)).alias(name))


_GAPS = ("kind", "line", "maker")
# Beside the block of all that a profile says: what may be filled from looser blocks, once all profiles of the block agree.
_LOOSER = (("maker", ("line", "kind")), ("kind", ("maker", "line")))


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """(profile columns p_..., merged columns m_...) for each distinct profile, merged until nothing changes.

    A profile may lack any of type, line and maker; a type that none of the known ones is counts as lacking beside
    known ones. In each round it is blocked on all it says, and on the two of maker, line and type that it says; if
    the richer profiles of a block agree in what it lacks, it takes that. Profiles made richer are in the next
    round's blocks. Every change fills an attribute, so it ends; only profiles with gaps are joined.
    """
    odd = F.col("kind").startswith("other")
    gaps = F.concat_ws(" ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in _GAPS])
    gaps = F.when((gaps == "") & odd, F.lit("kind")).otherwise(gaps)
    start = cut_lineage(profiles.select(*[F.col(c).alias(f"p_{c}") for c in PROFILE], *PROFILE).withColumn("round", F.lit(0)))
    whole, poor = start.where(gaps == ""), start.where(gaps != "")
    odd_whole = start.where((gaps == "kind") & F.col("kind").isNotNull())
    turn = 0
    while True:
        turn += 1
        tried = poor.withColumn("gaps", gaps)
        changed = tried.limit(0)
        for (pattern,) in tried.select("gaps").distinct().collect():  # at most one row per set of the three gaps
            lacking = pattern.split()
            rest = [c for c in PROFILE if c not in lacking]
            richer = whole if "kind" in lacking else whole.unionByName(odd_whole)
            changed = changed.unionByName(_filled(tried.where(F.col("gaps") == pattern), richer, lacking, rest))
        changed = cut_lineage(changed)
        left = _without(tried, changed)
        for lacking, block in _LOOSER:
            more = cut_lineage(_filled(left.where(F.col(lacking).isNull()), whole.unionByName(poor), [lacking], list(block)))
            changed = changed.unionByName(more)
            left = _without(left, more)
        changed = cut_lineage(changed.drop("gaps").withColumn("round", F.lit(turn)))
        if changed.isEmpty():
            break
        whole = cut_lineage(whole.unionByName(changed.where(gaps == "")))
        poor = cut_lineage(left.drop("gaps").unionByName(changed.where(gaps != "")))
    return whole.unionByName(poor).select(*[f"p_{c}" for c in PROFILE], *[F.col(c).alias(f"m_{c}") for c in PROFILE], "round")


def _without(profiles: DataFrame, taken: DataFrame) -> DataFrame:
    same = [F.col(f"x.p_{c}").eqNullSafe(F.col(f"y.p_{c}")) for c in PROFILE]
    return profiles.alias("x").join(taken.alias("y"), same, "left_anti")


def _filled(poor: DataFrame, richer: DataFrame, lacking: list[str], block: list[str]) -> DataFrame:
    """The poor profiles whose block's richer profiles agree in all that is lacking, with that filled in."""
    asked = poor.where(_all_said(block))
    keys = broadcast_if_small(cut_lineage(asked.select(*block).distinct()))
    of_block = richer.where(_all_said([*block, *lacking])).join(keys, block, "left_semi")
    said = of_block.groupBy(*block).agg(F.min(F.struct(*lacking)).alias("least"), F.max(F.struct(*lacking)).alias("greatest"))
    taken = asked.drop(*lacking).join(said.where(F.col("least") == F.col("greatest")), block)
    return taken.withColumns({c: F.col("least")[c] for c in lacking}).select(*poor.columns)


def _all_said(columns: list[str]) -> Column:
    said = F.lit(True)
    for c in columns:
        said = said & F.col(c).isNotNull()
    return said


def same_products(
    listings: DataFrame,
    brand_sources: DataFrame,
    *,
    id_column: str = "listing_id",
    brand: str = "brand",
    title: str = "item_name",
    flavour: str = "flavour",
    net: str = "net_quantity_grams",
    observed: str = "observed_at",
    ingested: str = "ingested_at",
    max_entries: int = 100_000,
) -> DataFrame:
    """(listing_id, product): the listings that say enough, with the product each describes.

    Defined cases: a listing that says nowhere its flavour or its size describes no product and gives no row; the
    same holds for one whose brand, line or type neither it nor richer profiles that agree say, where a title's words
    that nothing else explains are a line of their own, however rare; without a pack count the net quantity decides,
    else it is one; of rows with one id the last observed, then last ingested counts; a null id gives no row; an
    empty table gives none; other columns are ignored.
    """
    once = latest_by(
        listings.select(
            F.col(id_column).alias("id"), F.col(observed).alias("at"), F.col(ingested).alias("in"), F.col(brand).alias("brand"),
            F.col(title).alias("title"), F.col(flavour).alias("flavour"), F.col(net).alias("net"),
        ).where(F.col("id").isNotNull()),
        ["id"],
        ["at", "in"],
    )
    cut = cut_listings(once)
    known = CanonicalList(brand_sources, "brand_source_id", "brand_name", "brand_aliases", max_entries)
    dictionary = mark_companions(learn_dictionary(count_texts(cut), known), _looked(cut))
    said = cut_lineage(read_profiles(cut, dictionary).where(F.col("taste").isNotNull() & F.col("size").isNotNull()))
    merged = merge_profiles(said.select(*PROFILE).distinct())
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in PROFILE]
    # a title's own words may be a typing error of the line that its profile was given, but are no other line
    typed = F.levenshtein(F.substring("own", 2, 2**31 - 1), F.col("m_line"), 3).between(0, 3)
    line = F.when(F.col("own").isNull() | (F.col("line").isNotNull()) | F.coalesce(typed, F.lit(False)), F.col("m_line")).otherwise(F.col("own"))
    whole = said.join(merged, same).withColumn("m_line", line).where(_all_said([f"m_{c}" for c in PROFILE]))
    return whole.select(F.col("id").alias(id_column), F.concat_ws("|", *[f"m_{c}" for c in PROFILE]).alias("product"))


def product_pairs(members: DataFrame, id_column: str = "listing_id") -> DataFrame:
    """Each two listings of one product once, smaller id first; a join on the product, so no task gathers a product.

    Their number grows with the square of a product's listings; ``representative_pairs`` says the same in one row each.
    """
    a = members.select("product", F.col(id_column).alias(f"{id_column}_a"))
    b = members.select("product", F.col(id_column).alias(f"{id_column}_b"))
    return a.join(b, "product").where(F.col(f"{id_column}_a") < F.col(f"{id_column}_b")).select(f"{id_column}_a", f"{id_column}_b")


def representative_pairs(members: DataFrame, id_column: str = "listing_id") -> DataFrame:
    """Each listing with its product's representative, the listing of the smallest id, and how many listings the product has."""
    heads = members.groupBy("product").agg(F.min(id_column).alias("representative"), F.count("*").alias("listings"))
    return members.join(heads, "product").select(id_column, "representative", "listings")
