"""Reading one food listing: brand, product line, type, flavour, unit size and pack count from its free text.

A listing is first cut into words and quantities (``Cut``); what its words mean is looked up elsewhere, and comes back
as the listing's own small part of the dictionary, with which it is then read (``read``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from granary.llm.names import allowed_edits, edits, folded, unleeted

# Words of one meaning in flavours and product types, and two words for one. Typing errors are learned.
_SAME = {
    "choco": "chocolate", "choc": "chocolate", "chocolates": "chocolate", "minty": "mint", "salt": "salted", "berries": "berry", "piri": "peri", "pista": "pistachio",
    "kesar": "saffron", "gulab": "rose", "elaichi": "cardamom", "unflavored": "unflavoured", "cookies": "cookie", "soya": "soy", "yoghurt": "yogurt",
    "yoghurts": "yogurt", "yogurts": "yogurt", "chunks": "chunk", "bars": "bar", "nut": "nuts", "oat": "oats", "chip": "chips", "crisps": "chips", "flavor": "flavour",
    "flavored": "flavour", "flavoured": "flavour", "flavours": "flavour", "flavors": "flavour",
}
_JOINED = {("straw", "berry"): "strawberry", ("blue", "berry"): "blueberry", ("coco", "nuts"): "coconut", ("butter", "scotch"): "butterscotch", ("un", "flavour"): "unflavoured", ("pea", "nuts"): "peanut"}
_NO_FLAVOUR_WORD = frozenset(("flavour", "and", "n", "with", "taste"))

# Product types by the words that must all be there, the most telling first.
TYPES = (
    ("mass gainer", ("gainer",)), ("whey isolate", ("whey", "isolate")), ("whey isolate", ("wpi",)), ("whey concentrate", ("whey", "concentrate")),
    ("whey concentrate", ("wpc",)), ("casein", ("casein",)), ("peanut butter creamy", ("peanut", "creamy")), ("peanut butter crunchy", ("peanut", "crunchy")),
    ("peanut butter smooth", ("peanut", "smooth")), ("peanut butter", ("peanut", "butter")), ("peanut butter", ("peanut", "spread")),
    ("almond spread", ("almond", "spread")), ("almond spread", ("almond", "butter")), ("almond drink", ("almond", "drink")), ("almond drink", ("almond", "milk")),
    ("soy drink", ("soy", "drink")), ("soy drink", ("soy", "milk")), ("soy chunks", ("soy", "chunk")), ("soy nuts", ("soy", "nuts")), ("oat drink", ("oats", "drink")),
    ("granola", ("granola",)), ("muesli", ("muesli",)), ("oats", ("oats",)), ("skyr", ("skyr",)), ("greek yogurt", ("greek", "yogurt")), ("yogurt", ("yogurt",)),
    ("tofu", ("tofu",)), ("paneer", ("paneer",)), ("protein chips", ("chips",)), ("protein cookie", ("cookie",)), ("protein bar", ("bar",)),
    ("protein water", ("water",)), ("protein shake", ("shake",)), ("plant protein", ("plant", "protein")), ("plant protein", ("vegan", "protein")),
)
TYPE_WORDS = frozenset(w for _, words in TYPES for w in words)

# Words of titles that name no product line.
ORDINARY = tuple(
    """added advanced athletes authentic available baked bakehouse based best better block bottle bottles box boxes bundle butter buy carton
    case cash certified choice clear classic clean clusters combo concentrate creamy crunch crunchy cultured daily dairy deal deals delicious
    delivery diet discount drink each easy energy essential everyday exclusive express extra family farms festive firm fitness flavour foods
    fresh free friendly from genuine gluten goodness grain gram grams great ground health healthy high icelandic imported india indian
    ingredients instant isolate keto kitchen label labs limited litre litres made mass micellar milk mills mixed muscle natural naturally
    naturals newly nuggets nutrition nutritious offer offers official online only organic organics original pack packs pantry perfect piece
    pieces plus pouch powder premium price product products protein pure quality rated ready real recovery release rich roasted rolled saver
    sale seller serving shaker shipping size slow smooth snack special sport sports spread starter stock stone store strength style sugar
    super supplement supplements sweet taste tasty tested trial trusted units unsweetened value vegan vegetarian weight wellness whole with
    without women workout yummy""".split()
)
# What stands in a brand field that names no brand.
NO_BRAND = frozenset(("", "n a", "na", "none", "null", "nil", "unknown", "generic", "unbranded", "retail partner", "no brand", "not available", "not applicable", "tbd", "other", "others", "various", "imported", "local"))

PLAIN = frozenset(ORDINARY) | TYPE_WORDS

# Grams (or ml) per printed unit; the imperial ones are printed to a tenth.
_METRIC = {"kg": 1000.0, "g": 1.0, "mg": 0.001, "l": 1000.0, "dl": 100.0, "cl": 10.0, "ml": 1.0}
_IMPERIAL = {"oz": 28.349523125, "lb": 453.59237, "floz": 29.5735295625}
_WRITTEN = {
    "kg": "kgs?|kilos?|kilograms?", "mg": "mgs?|milligrams?", "g": "g|gms?|gr|grams?|grammes?", "ml": "mls?|millilitres?|milliliters?", "cl": "cls?|centilitres?",
    "dl": "dls?|decilitres?", "l": "l|ltrs?|lt|litres?|liters?", "floz": r"fl\.? ?oz", "oz": "ozs?|ounces?", "lb": "lbs?|pounds?",
}
_UNITS = "|".join(f"(?P<{k}>{v})" for k, v in _WRITTEN.items())
_SIZE = re.compile(rf"(?:(?P<times>\d+)\s*[x×*]\s*)?(?<![\d.,])(?P<number>\d+(?:[.,]\d+)*)\s*(?:{_UNITS})(?![a-z])(?:\s*each)?(?:\s*[x×*]\s*(?P<after>\d+)(?![\d.,]))?")
_COUNT = re.compile(
    r"(?:pack|box|set|case|carton|bundle|lot)\s*of\s*(\d+)|(\d+)\s*-?\s*(?:pack|pk)\b|\(?(\d+)\s*(?:pcs|pieces?|units?|ct|count|nos?|bars|bottles|cups|pouches|sachets)\b\)?|(?<![\w.])[x×]\s*(\d+)(?![\d.,]|\s*(?:g|gms?|ml|kg|oz|lbs?)\b)"
)


def _number(text: str) -> float:
    return float(re.sub(r",(?=\d{3}(?!\d))", "", text).replace(",", ".", 1) if text.count(",") <= 1 else text.replace(",", ""))


def words_of(text: str | None) -> list[str]:
    """Folded words with one writing per meaning; digits that stand for letters are letters."""
    words = [_SAME.get(w, w) for w in unleeted(folded(text)).split()]
    out: list[str] = []
    for w in words:
        if out and (out[-1], w) in _JOINED:
            out[-1] = _JOINED[out[-1], w]
        else:
            out.append(w)
    return out


def flavour_key(text: str | None) -> str | None:
    """A flavour's words, sorted, without 'flavour' and joining words; None if it says none."""
    words = [w for w in words_of(text) if w not in _NO_FLAVOUR_WORD]
    return " ".join(sorted(set(words))) or None


@dataclass
class Quantity:
    """What a listing says of its size: unit size between low and high, number of units, total between two bounds."""

    low: float | None = None
    high: float | None = None
    exact: bool = False
    count: int | None = None
    total_low: float | None = None
    total_high: float | None = None


def quantity_of(title: str, net: float | None) -> tuple[Quantity, str]:
    """The quantity stated by a title and a net quantity column of unknown scale, and the title without it."""
    said, rest = Quantity(), re.sub("[\\s\u200b\ufeff]+", " ", title.lower())
    for found in _SIZE.finditer(rest):
        unit = next(k for k in _WRITTEN if found[k])
        try:
            number = _number(found["number"])
        except ValueError:
            continue
        digits = len(re.split("[.,]", found["number"])[-1]) if re.search("[.,]", found["number"]) else 0
        slack = 0.0505 if unit in _IMPERIAL else 0.5 * 10.0**-digits if _METRIC[unit] > 10 and digits else 0.0
        factor = _IMPERIAL.get(unit) or _METRIC[unit]
        times = found["times"] or found["after"]
        if number <= 0 or (said.low is not None and (slack or said.exact)):
            continue
        said.exact = not slack
        said.low, said.high = (number - slack) * factor, (number + slack) * factor
        said.count = int(times) if times and int(times) > 0 else said.count
    rest = _SIZE.sub(" | ", rest)
    if (found := _COUNT.search(rest)) and said.count is None:
        said.count = int(next(x for x in found.groups() if x)) or None
    rest = _COUNT.sub(" | ", rest)
    if net is not None and net == net and 0 < net < float("inf"):
        grams = net * 1000 if net <= 20 else net
        slack = 1.45  # what rounding to a tenth of an ounce can take away
        said.total_low, said.total_high = grams - slack, grams + slack
    return said, rest


WIDEST = 4
# The roles of what is looked up: a brand field, a word, two words as one, neighbouring words as a flavour.
BRAND, WORD, JOINED, FLAVOUR = "B", "w", "p", "f"


@dataclass
class Cut:
    """A listing's words, without digits, and its quantity."""

    title: list[str]
    brand: list[str]
    flavour: list[str]
    taste: str | None
    said: Quantity


def cut_listing(brand: str | None, title: str | None, flavour: str | None, net: float | None) -> Cut:
    said, rest = quantity_of(title or "", net)
    if flavour and said.low is None:
        more, _ = quantity_of(flavour, None)
        said.low, said.high, said.exact, said.count = more.low, more.high, more.exact, said.count or more.count
    return Cut([w for w in words_of(rest) if not w.isdigit()], _field_words(brand), _field_words(flavour), _field_key(flavour), said)


@lru_cache(maxsize=50_000)
def _field_words(text: str | None) -> list[str]:
    return [w for w in words_of(text) if not w.isdigit()]


_field_key = lru_cache(maxsize=50_000)(flavour_key)


def _windows(words: list[str]) -> list[tuple[int, int, str]]:
    """(first, past last, flavour key) of up to four neighbouring words, the longest first, without those that only ordinary words make up."""
    found = []
    last = len(words)
    for i, first in enumerate(words):
        if first in _NO_FLAVOUR_WORD:
            continue
        window, ordinary = [first], first in _ORDINARY
        if not ordinary:
            found.append((i, i + 1, first))
        for j in range(i + 1, min(i + WIDEST, last)):
            word = words[j]
            if word in _NO_FLAVOUR_WORD:
                continue
            window.append(word)
            ordinary = ordinary and word in _ORDINARY
            if ordinary:
                continue
            kinds = set(window)
            if len(kinds) == len(window) or len(kinds) == 1:
                found.append((i, j + 1, " ".join(sorted(kinds))))
    found.sort(key=lambda w: w[0] - w[1])
    return found


_ORDINARY = frozenset(ORDINARY)


def looked_up(cut: Cut) -> list[tuple[str, str]]:
    """(role, text) of all that the dictionary may know of a listing's words."""
    found = {(WORD, w) for w in (*cut.title, *cut.brand) if len(w) >= 3 and w not in PLAIN}
    for words in (cut.title, cut.brand):
        found |= {(JOINED, a + b) for a, b in zip(words, words[1:]) if len(a) + len(b) >= 5 and not (a in PLAIN and b in PLAIN)}
    found |= {(FLAVOUR, key) for words in (cut.title, cut.flavour) for _, _, key in _windows(words)}
    if cut.taste:
        found.add((FLAVOUR, cut.taste))
    return sorted(found)


@dataclass(frozen=True)
class Meaning:
    """What a word means: a line, a brand, a flavour or ordinary word typed wrong, or that it is explained; and in how many listings its line stands."""

    line: str | None = None
    maker: str | None = None
    flavour: str | None = None
    spelled: str | None = None
    explained: bool = False
    vague: bool = False
    weight: int = 1


@dataclass
class Entries:
    """The part of the dictionary that one listing needs."""

    flavours: dict[str, str]
    words: dict[str, Meaning]
    joined: dict[str, Meaning]


def read(cut: Cut, maker: str | None, known: Entries) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """Brand, line, type and flavour, and last the words that stand for the line if none is known."""
    taste = cut.taste
    if taste is not None and taste not in known.flavours:
        taste = next((known.flavours[key] for _, _, key in _windows(cut.flavour) if key in known.flavours), taste)
    elif taste is not None:
        taste = known.flavours[taste]
    words = cut.title
    for first, last, key in _windows(words):
        if key in known.flavours:
            taste = taste or known.flavours[key]
            words = words[:first] + words[last:]
            break
    taste = taste or next((known.words[w].flavour for w in words if w in known.words and known.words[w].flavour), None)
    spelled = {known.words[w].spelled or w if w in known.words else w for w in words}
    kind = next((t for t, need in TYPES if spelled.issuperset(need)), None)
    maker = maker or _maker_in(words, known)
    line = _line_in(words, known) or _line_in(cut.brand, known)
    own = None
    if line is None:
        left = _unexplained(words, cut.brand, known)
        own = f"?{' '.join(left)}" if left else None
        if not any(known.words[w].vague for w in left if w in known.words):
            line = own
    if kind is None:
        counted = sorted({w for w in words if w in PLAIN and w != line})
        kind = f"other {' '.join(counted)}" if counted else None
    return maker, line, kind, taste, own


def _maker_in(words: list[str], known: Entries) -> str | None:
    """The brand that two words of a title joined name, else the first that a word names."""
    for told, parts in ((known.joined, [a + b for a, b in zip(words, words[1:])]), (known.words, words)):
        for w in parts:
            if w in told and told[w].maker:
                return told[w].maker
    return None


def _line_in(words: list[str], known: Entries) -> str | None:
    """Of the lines that words stand for, alone or joined, the one in most listings."""
    met = [known.words[w] for w in words if w in known.words] + [known.joined[a + b] for a, b in zip(words, words[1:]) if a + b in known.joined]
    best = max(((m.weight, m.line) for m in met if m.line and not m.explained), default=None)
    return best[1] if best else None


def _unexplained(words: list[str], brand: list[str], known: Entries) -> list[str]:
    """The words of a title that no brand, type, flavour or ordinary word explains; the short ones only if there are no others."""
    said = {*brand, "".join(brand)}
    none = Meaning()
    left = sorted({w for w in words if len(w) >= 3 and w not in PLAIN and w not in _NO_FLAVOUR_WORD and not ((m := known.words.get(w, none)).maker or (m.explained and not m.line))})
    left = [w for w in left if not any(edits(w, b, 2) <= allowed_edits(len(b)) for b in said)]
    return [w for w in left if len(w) >= 5] or left
