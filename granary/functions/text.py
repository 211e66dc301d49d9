"""Text, identifier and code functions as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SIGNS = "[™®©]"
_BETA = "[βΒ]"


def _decompositions() -> tuple[str, list[tuple[str, str]]]:
    """Characters whose compatibility decomposition has letters or digits of ASCII, or '&': the one-for-one map's source, and (character, text) of the longer ones."""
    single, longer = [], []
    for code in range(0xA0, sys.maxunicode + 1):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not "\u0300" <= c <= "\u036f")
        if plain != char and any(c.isascii() and (c.isalnum() or c == "&") for c in plain):
            (single if len(plain) == 1 else longer).append((char, plain))
    return single, longer


_FOLDS: list = []


def _folded(text: Column) -> Column:
    """Compatibility decomposition without combining marks, as far as letters and digits of ASCII come out of it.

    Characters that decompose to one letter are translated in one pass; those that decompose to several (ligatures,
    fractions, Roman numerals and the like) are few, and only texts that hold one are looked at for them.
    """
    if not _FOLDS:
        _FOLDS.extend(_decompositions())
    single, longer = _FOLDS
    one = F.regexp_replace(F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single)), "[\u0300-\u036f]", "")
    table = F.create_map(*[F.lit(x) for pair in longer for x in pair])
    spelled = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(one.rlike("[" + "".join(a for a, _ in longer) + "]"), spelled).otherwise(one)


def normalize_text(text: Column) -> Column:
    """Lower-case letters and digits in words: signs dropped, compatibility forms and accents folded, '&' spelled out; '' for null.

    All of it is built-in expressions; ``plain_text`` is the same on the driver.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _SIGNS, ""), _BETA, " beta ")
    plain = F.when(bare.rlike("^[ -~]*$"), bare).otherwise(_folded(bare))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "&", " and "), "[^a-z0-9]+", " "))


def plain_text(text: str) -> str:
    bare = re.sub(_BETA, " beta ", re.sub(_SIGNS, "", text))
    bare = "".join(c for c in unicodedata.normalize("NFKD", bare) if not "\u0300" <= c <= "\u036f")
    return re.sub("[^a-z0-9]+", " ", bare.lower().replace("&", " and ")).strip()


@F.pandas_udf(StringType())
def comparable_text(texts: pd.Series) -> pd.Series:
    """NFKC, lower case, runs of white space as one space."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).lower().split()) if t is not None else None)


def gtin_check_digit_ok(digits: Column) -> Column:
    """Whether the last digit is the mod-10 check digit of the others (weights 3, 1 from the right)."""
    body = F.reverse(F.substring(digits, 1, F.length(digits) - 1))
    weighed = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c, i: c.try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.coalesce(digits.rlike("^[0-9]{2,}$") & ((10 - total % 10) % 10 == F.right(digits, F.lit(1)).try_cast("int")), F.lit(False))


def gtin14(raw: Column) -> Column:
    """A valid GTIN of 8, 12, 13 or 14 digits as 14 digits; null for anything else."""
    digits = F.regexp_replace(raw, r"[\s\-]", "")
    return F.when(digits.rlike(r"^(\d{8}|\d{12,14})$") & gtin_check_digit_ok(digits), F.lpad(digits, 14, "0"))


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 24))


def plain_number(value: Column) -> Column:
    """A double as text without a trailing '.0'."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def composite_key(brand: Column, name: Column, flavour: Column, grams: Column) -> Column:
    """'brand|name|flavour|grams', normalised; null if any part is missing."""
    parts = [normalize_text(c) for c in (brand, name, flavour)]
    said = (parts[0] != "") & (parts[1] != "") & (parts[2] != "") & (grams > 0)
    return F.when(F.coalesce(said, F.lit(False)), F.concat_ws("|", *parts, plain_number(grams)))


# Units of a printed quantity, as patterns, and what one is in grams or millilitres; and the whole pattern.
_MASS = {"kilograms?|kgs?": 1000.0, "grams?|g": 1.0}
_VOLUME = {"millilit(?:er|re)s?|ml": 1.0, "centilit(?:er|re)s?|cl": 10.0, "decilit(?:er|re)s?|dl": 100.0, "lit(?:er|re)s?|l": 1000.0}
QUANTITY = rf"(?:^|[^0-9.])(\d+(?:\.\d+)?)\s*({'|'.join([*_MASS, *_VOLUME])})\b"


def parse_quantity(text: Column) -> Column:
    """The first positive number with a metric unit: struct(value, unit, grams, millilitres); null if there is none."""
    low = F.lower(F.trim(text))
    value = F.regexp_extract(low, QUANTITY, 1).try_cast("double")
    unit = F.regexp_extract(low, QUANTITY, 2)

    def scaled(table: dict[str, float]) -> Column:
        found = F.lit(None).cast("double")
        for words, factor in table.items():
            found = F.when(unit.rlike(f"^(?:{words})$"), value * factor).otherwise(found)
        return found

    return F.when(value > 0, F.struct(value.alias("value"), unit.alias("unit"), scaled(_MASS).alias("grams"), scaled(_VOLUME).alias("millilitres")))


# Where a name or a description states a pack's size, the most telling first, and grams per unit there.
_SIZE = r"(\d+(?:\.\d+)?)\s*"
PACK_SIZES = (
    (rf"(?i)\b{_SIZE}(?:kg|kilograms?)\b", 1000),
    (rf"(?i)\b(?:pack(?:\s+of)?|box|jar|pouch|tub|net\s*(?:wt|weight)?|weight)\s*\(?\s*{_SIZE}(?:g|grams?)\b", 1),
    (rf"(?i)\b{_SIZE}(?:g|grams?)\s*(?:$|[|,/(])", 1),
)
NET_WEIGHT = rf"(?i)\b(?:net\s*(?:wt|weight|qty)?|pack\s*weight)\s*:?\s*{_SIZE}(kg|kilograms?|g|grams?)\b"


def declared_pack_grams(name: Column, description: Column) -> Column:
    """Grams of a pack by the first pattern that finds a size above 0 in its name, else the net weight its description states."""
    sizes = [F.regexp_extract(name, pattern, 1).try_cast("double") * factor for pattern, factor in PACK_SIZES]
    thousand = F.when(F.lower(F.regexp_extract(description, NET_WEIGHT, 2)).startswith("k"), 1000).otherwise(1)
    sizes.append(F.regexp_extract(description, NET_WEIGHT, 1).try_cast("double") * thousand)
    return F.coalesce(*[F.when(size > 0, size) for size in sizes])


def clean_tag(tag: Column) -> Column:
    return normalize_text(F.regexp_replace(F.regexp_replace(tag, "(?i)^[a-z]{2}:", ""), "-", " "))


def percentages(text: Column) -> Column:
    """All numbers before a per cent sign."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda n: n.cast("double"))


def invalid_percentages(text: Column) -> Column:
    return F.filter(percentages(text), lambda n: n > 100)


def additive_codes(text: Column, tags: Column | None = None) -> Column:
    """Distinct 'INS nnn' codes of a text, then of e-number tags, in order of appearance."""
    said = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(?:ins\s*)?([1-9]\d{2,3}[a-z]?)\b"), F.lit(1))
    tagged = F.array().cast("array<string>") if tags is None else F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)(?:^|:)e(\d{3,4}[a-z]?)", 1)), lambda c: c != "")
    return F.array_distinct(F.transform(F.concat(said, F.coalesce(tagged, F.array().cast("array<string>"))), lambda c: F.concat(F.lit("INS "), F.upper(c))))


# Ordered category rules, the first that matches normalised text decides.
CATEGORY_RULES = (
    ("protein_powder", "whey|casein|protein powder|protein supplement"),
    ("protein_bar", "protein bar|energy bar"),
    ("soy_product", "soy chunks?|soya chunks?|tofu|soy product"),
    ("dairy", "greek yogurt|yoghurt|paneer|cheese|dairy"),
    ("plant_dairy", "plant milk|plant based milk|vegan milk"),
    ("ready_to_drink", "protein shake|protein drink|ready to drink|beverage"),
    ("breakfast", "cereal|oat|muesli|breakfast|idly|ready mix"),
    ("spread", "peanut butter|nut butter|spread"),
    ("protein_snack", r"protein(?:\s+[a-z]+){0,3}\s+(?:chips?|snacks?|puffs?|wafers?|makhana|crisps?|mix|bites?|balls?|pops?)"),
)


def first_match(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The name of the first rule whose pattern is found in ``text``."""
    chain = F.when(F.lit(False), F.lit(otherwise))
    for name, pattern in rules:
        chain = chain.when(text.rlike(pattern), F.lit(name))
    return chain.otherwise(F.lit(otherwise))


def category_of(*texts: Column) -> Column:
    return first_match(normalize_text(F.concat_ws(" ", *texts)), CATEGORY_RULES, "other")


# Tags that end a line, and the entities that are decoded.
LINE_ENDS = r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])\s*>"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&#(?:0*39|x27);": "'", "&quot;": '"'}


def html_to_text(html: Column) -> Column:
    """Text of a page: a line end for each tag that ends a line, a space for any other, common entities decoded."""
    text = F.regexp_replace(F.regexp_replace(F.translate(html, "\r", ""), LINE_ENDS, "\n"), "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        text = F.regexp_replace(text, f"(?i){entity}", char)
    return text


def is_https_url(url: Column) -> Column:
    """An https address with a host and without user information."""
    return F.coalesce(url.rlike(r"^https://[^/\s?#@]+([/?#]\S*)?$"), F.lit(False))


def reason_codes_ok(codes: Column) -> Column:
    """Whether all codes have the allowed form and none repeats."""
    return F.forall(codes, lambda c: c.rlike("^[a-z0-9][a-z0-9._:-]*$")) & (F.size(codes) == F.size(F.array_distinct(codes)))


def label_reference(url: Column) -> Column:
    """struct(tail, revision, image_id) of a label picture's address such as .../front_en.12.400.jpg or .../7.jpg."""
    path = F.try_parse_url(url, F.lit("PATH"))
    tail = F.element_at(F.split(path, "/"), -1)
    return F.struct(tail.alias("tail"), F.regexp_extract(tail, r"^[^.]+\.(\d+)\.", 1).try_cast("int").alias("revision"), F.regexp_extract(tail, r"^([^.]+)", 1).alias("image_id"))


def in_country(tags: Column, countries: Column, country: str) -> Column:
    """Whether a tag names the country, or its name is a word of the countries text."""
    tagged = F.exists(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: normalize_text(t).isin(country, f"en {country}"))
    return tagged | F.array_contains(F.split(normalize_text(countries), " "), country)
