"""Evaluation items that stand in training documents, whole or in part, by template windows.

Words of both sides are canonicalised: numbers, units and names become typed placeholders, so that a passage whose
numbers or names were exchanged still has its items' templates. Windows of template words are hash-joined; in the
matched windows the slots are then checked: words that agree letter for letter count as held, exchanged slots count
only if they were exchanged consistently, which shows a re-parameterised copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import cut_lineage

# Number words and unit words that become placeholders.
_NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half quarter"
).split()
_UNIT_WORDS = (
    "g kg mg ml cl dl l oz lb kcal kj gram grams kilogram kilograms milligram milligrams hectogram hectograms decagram decagrams decigram decigrams "
    "centigram centigrams microgram micrograms litre litres liter liters millilitre millilitres ounce ounces pound pounds dram drams grain grains "
    "scruple scruples pennyweight pennyweights stone tonne tonnes calorie calories percent"
).split()
_STRETCH = 2_000
_NUMBER, _UNIT, _NAME = 1, 2, 3  # codes of placeholders; every other code is a word's hash


def words_of(text: Column) -> Column:
    """Words as written, without punctuation; a word broken over two lines is one."""
    joined = F.regexp_replace(F.regexp_replace(text, "\u00ad", ""), r"(?<=[\p{L}\p{N}\-])-[ \t]*\r?\n[ \t]*(?=[\p{L}\p{N}\-])", "")
    return F.filter(F.split(joined, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _template(words: Column, names: list[str]) -> Column:
    """The code of each word: a placeholder, or its hash; a name is one of ``names``, or has digits among letters."""

    def one(word: Column) -> Column:
        low = F.lower(word)
        kind = F.when(low.rlike(r"^\d+$") | low.isin(_NUMBER_WORDS), F.lit(_NUMBER).cast("long")).when(low.isin(_UNIT_WORDS), F.lit(_UNIT).cast("long"))
        return kind.when(low.isin(names) | low.rlike(r"^\p{L}+\d[\p{L}\d]*$"), F.lit(_NAME).cast("long")).otherwise(F.xxhash64(low))

    return F.transform(words, one)


def _windows(source: DataFrame, key: str, text: str, names: list[str], width: int) -> DataFrame:
    """key, size, first, literal (word hashes of a stretch of the text) and, one row per window, at (from 1 within the stretch) and code.

    A window's code is that of its template if at least two of its words are no placeholders, else that of its words
    as they are: templates of hardly anything but placeholders would meet everywhere and say nothing.
    """
    words = source.select(F.col(key), words_of(F.col(text)).alias("words"))
    coded = words.where(F.size("words") >= width).select(key, F.size("words").alias("size"), F.transform("words", lambda w: F.hash(F.lower(w))).alias("literal"), _template(F.col("words"), names).alias("template"))
    # long texts are first cut into stretches that overlap by a window, so that no row holds all windows of a text
    last = F.col("size") - (width - 1)
    stretch = coded.select(key, "size", F.explode(F.sequence(F.lit(1), last, F.lit(_STRETCH))).alias("first"), "literal", "template").select(
        key, "size", "first", *[F.slice(c, F.col("first"), F.lit(_STRETCH + width - 1)).alias(c) for c in ("literal", "template")]
    )

    def code(i: Column) -> Column:
        parts = [F.get("template", i + (k - 1)) for k in range(width)]
        plain = sum((F.when(p.between(_NUMBER, _NAME), 0).otherwise(1) for p in parts[1:]), F.when(parts[0].between(_NUMBER, _NAME), 0).otherwise(1))
        return F.when(plain >= 2, F.xxhash64(*parts)).otherwise(F.xxhash64(F.lit("as written"), *[F.get("literal", i + (k - 1)) for k in range(width)]))

    codes = F.transform(F.sequence(F.lit(1), F.size("literal") - (width - 1)), code)
    return stretch.select(key, "size", "first", "literal", F.posexplode(codes).alias("at", "code")).withColumn("at", F.col("at") + 1)


def item_names(items: DataFrame, text: str, most: int) -> list[str]:
    """Words that the items only ever write with a capital and at least once within a sentence, the ``most`` frequent of them.

    Names beyond that are words as others: they still agree letter for letter, but exchanging them is not seen.
    """
    placed = F.explode(F.split(text, r"[^\p{L}\p{M}\p{N}]+"))
    inner = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}{3,})"), F.lit(1))
    capital = items.select(F.explode(inner).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    small = items.select(placed.alias("w")).where(F.col("w").rlike(r"^\p{Ll}")).distinct()
    rows = capital.join(small, "w", "left_anti").orderBy(F.desc("n"), "w").limit(most).collect()
    return sorted(r.w for r in rows)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc: str = "doc_id",
    doc_text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    share: float = 0.4,
    max_item_windows: int = 2_000_000,
    max_names: int = 20_000,
) -> DataFrame:
    """doc_id, item_id, held, exchanged, consistent, reworked: the documents that hold at least ``share`` of an item's words.

    ``held`` is the share of the item's words that agree letter for letter within matched windows. ``exchanged``
    counts its slots whose number, unit or name another takes the place of; they are ``consistent`` if each of the
    item's words was exchanged for one word only. A pair is in the result if ``held`` alone reaches ``share``, or
    (``reworked``) if it does so with consistent exchanged slots and at least half as many words agree as are asked.

    The items' windows are broadcast if they are at most ``max_item_windows``, so the documents' windows are neither
    shuffled nor stored; beyond that the join shuffles. Matched windows are aggregated per document and place of an
    item, within a task before the shuffle: a mask of the words that agree somewhere, and the one window that agrees
    best. So a document of any length, however repetitive, costs time in proportion to its length.

    Defined cases: null and empty texts, and items of fewer than ``width`` words (a short snatch), hold and are held
    by nothing; an item under two ids gives both; repeated rows count once; null ids give no rows; other columns are
    ignored.
    """
    held_out = cut_lineage(items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct())
    names = item_names(held_out, "text", max_names)
    window = lambda: F.slice("literal", F.col("at"), width)
    asked = cut_lineage(_windows(held_out, "item", "text", names, width).select("item", F.col("size").alias("item_size"), (F.col("first") + F.col("at") - 1).alias("item_place"), "code", window().alias("asked")))
    texts = documents.select(F.col(doc).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    said = _windows(texts, "doc", "text", names, width)
    if asked.limit(max_item_windows + 1).count() <= max_item_windows:
        met = said.join(F.broadcast(asked), "code").withColumn("told", window())  # sliced after the join: few windows meet
    else:
        met = said.select("doc", "code", window().alias("told")).join(asked, "code")
    same = [F.get("told", F.lit(k)) == F.get("asked", F.lit(k)) for k in range(width)]
    mask = sum((F.when(s, 1 << k).otherwise(0) for k, s in enumerate(same[1:], 1)), F.when(same[0], 1).otherwise(0))
    met = met.select("doc", "item", "item_size", "item_place", "asked", mask.alias("mask"), "told")
    best = F.max(F.struct(F.bit_count("mask").alias("agree"), "told"))["told"]
    seen = met.groupBy("doc", "item", "item_size", "item_place", "asked").agg(F.bit_or("mask").alias("mask"), best.alias("told"))
    place = lambda k: F.col("item_place") + k
    agreed = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, place(k)) for k in range(width)]), lambda p: p.isNotNull())
    differ = lambda k: F.get("told", F.lit(k)) != F.get("asked", F.lit(k))
    swap = lambda k: F.shiftleft(F.get("asked", F.lit(k)).cast("long"), 32) + F.get("told", F.lit(k)).cast("long")
    swaps = F.filter(F.array(*[F.when(differ(k), F.struct(place(k).alias("place"), F.get("asked", F.lit(k)).alias("word"), swap(k).alias("swap"))) for k in range(width)]), lambda s: s.isNotNull())
    flat = seen.select("doc", "item", "item_size", agreed.alias("agreed"), swaps.alias("swaps"))
    # at most ``width`` entries for each place of one item
    whole = flat.groupBy("doc", "item", "item_size").agg(F.array_distinct(F.flatten(F.collect_list("agreed"))).alias("agreed"), F.flatten(F.collect_list("swaps")).alias("swaps"))
    kept = F.map_from_entries(F.transform("agreed", lambda p: F.struct(p, F.lit(True))))
    changed = whole.withColumn("kept", kept).withColumn("swaps", F.filter("swaps", lambda s: F.try_element_at("kept", s["place"]).isNull()))
    distinct = lambda field: F.size(F.array_distinct(F.transform("swaps", lambda s: s[field])))
    told = changed.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "item_size", F.size("agreed").alias("agreed"), distinct("place").alias("exchanged"), (distinct("swap") == distinct("word")).alias("consistent"),
    )
    asked_words = share * F.col("item_size")
    literal = F.col("agreed") >= asked_words
    reworked = ~literal & F.col("consistent") & (F.col("agreed") + F.col("exchanged") >= asked_words) & (F.col("agreed") >= asked_words / 2)
    found = told.withColumn("reworked", reworked).where(literal | reworked)
    return found.select("doc_id", "item_id", (F.col("agreed") / F.col("item_size")).alias("held"), "exchanged", "consistent", "reworked")
