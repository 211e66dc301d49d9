"""Several values packed in one text field: one row per value, place kept.

Each text is cut into alternating ordinary and delimiter pieces (brackets and quoted values are ordinary). Masking
the ordinary pieces leaves the text's delimiter skeleton, such as 'xcxcx' for 'milk, egg, soy'. What splits and
what doesn't is decided once per distinct skeleton; the resulting piece spans are joined back and applied to the
pieces by position. Work on rows is built-in expressions, and Python sees distinct skeletons only, but for texts
whose brackets nest deeper than a pattern can say: those are cut by a scan that counts the depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from granary.session import cut_lineage, latest_by

# Private-use characters that stand around delimiters while a text is cut.
_OPEN, _SHUT = "\ue000", "\ue002"

_SPACE = "\\s\u00a0\u200b\ufeff"
_TRIM = rf"^[{_SPACE}]+|[{_SPACE}]+$"


def _bracketed(depth: int) -> str:
    inner = "" if depth == 1 else f"(?:{_bracketed(depth - 1)}[^()\\[\\]{{}}（）]*+)*+"
    return rf"[(\[{{（][^()\[\]{{}}（）]*+{inner}[)\]}}）]"


# What counts as one delimiter; every other character is ordinary.
_QUOTED = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|“[^”]*+”'
_MARK = rf"(?<![^{_SPACE}])(?:\(\d{{1,3}}\)|\d{{1,3}}[.)])(?=[{_SPACE}])"
_DECIMAL = r"\d[.,]\d"
_DELIMITERS = (
    ("n", r"\r\n|[\n\r\u2028\u2029]|<[bB][rR]\s*/?>"),
    ("t", r"\t"),
    ("p", r"[|¦]"),
    ("s", r"[;；]"),
    ("c", r"[,，、]"),
    ("h", rf"(?<![^{_SPACE}])/(?![^{_SPACE}])"),
    ("a", r"[&＆]"),
    ("b", r"[•·●▪◦‣∙]"),
    ("d", rf"(?<![^{_SPACE}])[-*–—](?=[{_SPACE}])"),
    ("w", rf"(?<=[{_SPACE}])[aA][nN][dD](?=[{_SPACE}])"),
)
_DEPTH = 6  # of the pattern; deeper texts go to ``_deep_pieces``
_DELIMITER = f"{_MARK}|{'|'.join(p for _, p in _DELIMITERS)}"
_CUT = f"({_DECIMAL}|{_QUOTED}|(?!{_MARK}){_bracketed(_DEPTH)})|({_DELIMITER})"
_OPENING, _CLOSING = "([{（", ")]}）"

# Words that lead in a whole list, and texts that say nothing.
_LEAD_IN = r"(?i)^(?:ingredients?(?:\s+list)?|contains?|may\s+contain(?:\s+traces(?:\s+of)?)?|traces?(?:\s+of)?|allergens?)\s*(?:[:：\-–—]\s*|\s+|$)"
_SAYS_NOTHING = ("", "-", "--", "–", "—", ".", "?", "n/a", "n.a", "na", "nil", "none", "null", "nan", "not applicable", "not available", "not known", "unknown", "tbd", "tba", "nothing", "[]")

ALWAYS, WITH_AND = "o", "w"


def _pieces(text: Column) -> Column:
    """Alternating ordinary (even) and delimiter (odd) pieces of a text."""
    marked = F.regexp_replace(text, _CUT, f"$1{_OPEN}$2{_SHUT}")
    return F.split(F.regexp_replace(marked, _OPEN + _SHUT, ""), f"[{_OPEN}{_SHUT}]", -1)


def nesting(text: Column) -> Column:
    """How deep the brackets of a text go: the most opened and not yet closed at any place, or the same read from the end, if that is less."""

    def deepest(brackets: Column, opening: str) -> Column:
        step = lambda a, c: F.struct(
            F.greatest(F.lit(0), a["open"] + F.when(F.contains(F.lit(opening), c), 1).otherwise(-1)).alias("open"),
            F.greatest(a["most"], a["open"] + F.when(F.contains(F.lit(opening), c), 1).otherwise(-1)).alias("most"),
        )
        return F.aggregate(brackets, F.struct(F.lit(0).alias("open"), F.lit(0).alias("most")), step, lambda a: a["most"])

    each = F.filter(F.split(F.regexp_replace(text, r"[^()\[\]{}（）]+", ""), ""), lambda c: c != "")
    return F.when(text.rlike(r"[(\[{（]"), F.least(deepest(each, _OPENING), deepest(F.reverse(each), _CLOSING))).otherwise(F.lit(0))


_TOKENS = re.compile(f"(?P<plain>{_DECIMAL}|{_QUOTED})|(?P<mark>{_MARK})|(?P<bracket>[()\\[\\]{{}}（）])|(?P<delimiter>{'|'.join(p for _, p in _DELIMITERS)})")


def cut_deep(text: str) -> list[str]:
    """Alternating ordinary and delimiter pieces of a text with brackets of any depth: what stands in closed brackets is ordinary."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKENS.finditer(text)]
    open_at: list[int] = []
    inside = [0] * (len(tokens) + 1)  # how many closed bracket pairs begin (+1) or end (-1) at a token
    for i, (kind, start, _) in enumerate(tokens):
        if kind == "bracket" and text[start] in _OPENING:
            open_at.append(i)
        elif kind == "bracket" and open_at:
            inside[open_at.pop()] += 1
            inside[i] -= 1
    pieces, last, depth = [], 0, 0
    for i, (kind, start, end) in enumerate(tokens):
        depth += inside[i]
        if depth == 0 and kind in ("mark", "delimiter"):
            pieces += [text[last:start], text[start:end]]
            last = end
    return [*pieces, text[last:]]


@F.pandas_udf(ArrayType(StringType()))
def _deep_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: cut_deep(t) if t is not None else None)


def _skeleton(pieces: Column, and_splits: Column) -> Column:
    """The pieces masked: one letter per delimiter's kind, x for ordinary text, _ for white space, after the field's kind."""

    def letter(piece: Column, place: Column) -> Column:
        kind = F.when(piece.rlike(r"^\(?\d"), F.lit("m"))
        for name, pattern in _DELIMITERS:
            bare = {"h": "/", "d": "[-*–—]", "w": "[aA][nN][dD]"}.get(name, pattern)
            kind = kind.when(piece.rlike(f"^(?:{bare})$"), F.lit(name))
        return F.when(place % 2 == 1, kind).when(piece.rlike(rf"^[{_SPACE}]*$"), F.lit("_")).otherwise(F.lit("x"))

    return F.concat(F.when(and_splits, F.lit(WITH_AND)).otherwise(F.lit(ALWAYS)), F.array_join(F.transform(pieces, letter), ""))


def resolve_skeleton(skeleton: str) -> list[tuple[int, int]]:
    """Spans of pieces (first, count), one per value, by the rules for one skeleton.

    Line ends, tabs, bars, semicolons, commas, spaced slashes and '&' split wherever they stand outside brackets
    and quotes; the word 'and' only in a field whose kind says so. Bullets, dashes and numbers are list marks, and
    split, only in a text that begins with one of their kind; elsewhere they are part of a value.
    """
    kind, letters = skeleton[0], skeleton[1:]
    splits = set("ntpsch") | {"a"} | ({"w"} if kind == WITH_AND else set())
    first = next((c for c in letters if c != "_" and c != "n"), "x")
    if first in "bdm":
        splits.add(first)
    spans, start = [], 0
    for place in range(1, len(letters) + 1, 2):
        if place >= len(letters) or letters[place] in splits:
            if "x" in letters[start:place] or any(c in letters[start:place] for c in "bdmw"):
                spans.append((start, place - start))
            start = place + 1
    return spans


RULES = "skeleton string, spans array<struct<first:int,pieces:int>>"


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [[{"first": a + 1, "pieces": n} for a, n in resolve_skeleton(s)] for s in batch["skeleton"]]
        yield pd.DataFrame({"skeleton": batch["skeleton"], "spans": spans})


def _clean(value: Column) -> Column:
    """Without surrounding white space and quoting; a doubled or escaped quote within quoting is one quote."""
    bare = F.regexp_replace(value, _TRIM, "")
    unquoted = F.regexp_replace(F.regexp_replace(bare, r'^(?s)"(.*)"$', "$1"), r'""|\\"', '"')
    return F.regexp_replace(F.when(bare.rlike(r'^(?s)".*"$'), unquoted).otherwise(F.regexp_replace(bare, r"^(?s)“(.*)”$", "$1")), _TRIM, "")


def _whole_list(text: Column) -> Column:
    """The list itself: no outer white space, lead-in words, closing stop or brackets of a JSON array; null if it says nothing."""
    bare = F.regexp_replace(F.translate(text, _OPEN + _SHUT, ""), _TRIM, "")
    bare = F.regexp_replace(bare, _LEAD_IN, "")
    bare = F.regexp_replace(bare, rf"(?<!\.)\.[{_SPACE}]*$", "")
    bare = F.regexp_replace(bare, r'^(?s)\[\s*("(?:.*)")\s*,?\s*\]$', "$1")
    bare = F.regexp_replace(bare, _TRIM, "")
    return F.when(~F.lower(bare).isin(*_SAYS_NOTHING), bare)


def unpack_fields(
    labels: DataFrame,
    *,
    id_column: str = "label_id",
    fields: tuple[str, ...] = ("ingredients_raw", "contains_raw", "traces_raw"),
    and_fields: tuple[str, ...] = ("contains_raw", "traces_raw"),
    observed: str = "observed_at",
    max_broadcast: int = 20_000,
) -> DataFrame:
    """Each value of the packed ``fields`` on its own row, with its place from 0.

    The table of rules has one row per distinct skeleton. Its ``max_broadcast`` most frequent skeletons are
    broadcast; rows of any rarer ones are joined by shuffle, where none of them can be hot.

    Defined cases: a field that is null, blank or says nothing gives no rows; empty values aren't counted;
    brackets may nest to any depth; unbalanced brackets and unbalanced quotes are ordinary characters; a row delivered again counts once (the last observed of one id); a null id gives no rows; other columns are ignored.

    Returns label_id, field_name, pos, item_text.
    """
    own = [F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    once = latest_by(labels.select(F.col(id_column).alias("id"), F.col(observed).alias("at"), *own).where(F.col("id").isNotNull()), ["id"], ["at"])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(f in and_fields).alias("ands"), F.col(f"f{i}").alias("text")) for i, f in enumerate(fields)]))
    cut = (
        once.select("id", each.alias("e"))
        .select("id", "e.field", "e.ands", _whole_list(F.col("e.text")).alias("list"))
        .where(F.col("list").isNotNull())
        .withColumn("deep", _deep_pieces(F.when(nesting(F.col("list")) > _DEPTH, F.col("list"))))
        .select("id", "field", "ands", F.coalesce("deep", _pieces(F.col("list"))).alias("pieces"))
        .withColumn("skeleton", _skeleton(F.col("pieces"), F.col("ands")))
        .select("id", "field", "pieces", "skeleton")
    )
    cut = cut_lineage(cut)
    counted = cut.groupBy("skeleton").count()
    rules = cut_lineage(counted.select("skeleton").mapInPandas(_resolve, RULES))
    if rules.limit(max_broadcast + 1).count() <= max_broadcast:
        ruled = cut.join(F.broadcast(rules), "skeleton")
    else:
        frequent = cut_lineage(counted.orderBy(F.desc("count"), "skeleton").limit(max_broadcast).select("skeleton"))
        hot = F.broadcast(rules.join(F.broadcast(frequent), "skeleton"))
        rare = cut.join(F.broadcast(frequent), "skeleton", "left_anti")
        ruled = cut.join(hot, "skeleton").unionByName(rare.join(rules, "skeleton"))
    item = F.transform("spans", lambda s: _clean(F.array_join(F.slice("pieces", s["first"], s["pieces"]), "")))
    return (
        ruled.select("id", "field", F.filter(item, lambda v: v != "").alias("items"))
        .select(F.col("id").alias("label_id"), F.col("field").alias("field_name"), F.posexplode("items").alias("pos", "item_text"))
    )
