"""Products and nutrition tables out of web pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import html_to_text, normalize_text

_SCRIPT = re.compile(r"<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)
_PROPERTY = re.compile(r"<[^>]*\bitemprop=[\"']([^\"']+)[\"'][^>]*?(?:content=[\"']([^\"']*)[\"'][^>]*>|>([^<]*))", re.I)


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _is_a(node: Any, kind: str) -> bool:
    return isinstance(node, dict) and kind in _listed(node.get("@type"))


def _nodes(value: Any) -> Iterator[dict]:
    """The nodes of a JSON-LD document: those of its graph, else itself."""
    for node in _listed(value):
        if isinstance(node, dict):
            graph = node.get("@graph")
            yield from (n for n in graph if isinstance(n, dict)) if isinstance(graph, list) else (node,)


def _described(node: dict) -> list[dict]:
    """The products a node describes: itself, or the variants of a product group."""
    if _is_a(node, "Product"):
        return [node]
    return [v for v in _listed(node.get("hasVariant")) if _is_a(v, "Product")] if _is_a(node, "ProductGroup") else []


def _parsed(script: str) -> Any:
    try:
        return json.loads(script)
    except (ValueError, RecursionError):
        return None


def json_ld_products(html: str) -> list[dict]:
    """The products of the first JSON-LD node that describes any."""
    told = (_described(node) for script in _SCRIPT.findall(html) for node in _nodes(_parsed(script)))
    return next((products for products in told if products), [])


def microdata(html: str) -> dict[str, str]:
    """The first value of each item property."""
    found: dict[str, str] = {}
    for name, content, inner in _PROPERTY.findall(html):
        found.setdefault(name.lower(), unescape(content or inner).strip())
    return found


def embedded_object(html: str, marker: str) -> dict | None:
    """The JSON object that begins after ``marker``; braces within strings don't count."""
    start = html.find("{", html.find(marker) + len(marker)) if marker in html else -1
    if start < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(html, start)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def products_of_pages(pages: DataFrame, id_column: str, html: str) -> DataFrame:
    """page, position, name, brand, sku, gtin, evidence of the products that JSON-LD, else microdata, describes."""

    def text(value) -> str | None:
        value = value.get("name") if isinstance(value, dict) else value
        return str(value).strip() if isinstance(value, (str, int)) and str(value).strip() else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, page in zip(batch["page"], batch["html"]):
                products = [(p, "json_ld") for p in json_ld_products(page)]
                if not products and (found := microdata(page)).get("name"):
                    products = [(found, "microdata")]
                for i, (p, evidence) in enumerate(products):
                    gtin = next((text(p.get(k)) for k in ("gtin", "gtin14", "gtin13", "gtin12", "gtin8") if text(p.get(k))), None)
                    rows.append((key, i, text(p.get("name")), text(p.get("brand")), text(p.get("sku")), gtin, evidence))
            yield pd.DataFrame(rows, columns=["page", "position", "name", "brand", "sku", "gtin", "evidence"])

    held = pages.select(F.col(id_column).cast("string").alias("page"), F.col(html).alias("html")).where(F.col("html").isNotNull())
    return held.mapInPandas(parse, "page string, position int, name string, brand string, sku string, gtin string, evidence string")


# Row names of a nutrition table, the first that is there counting, and the unit each is declared in.
TABLE_ROWS = {
    "calories": (("energy", "calories", "calorie"), "kcal|kilocalories?"),
    "protein": (("protein",), "g|grams?"),
    "carbohydrate": (("carbohydrate", "carbohydrates", "total carbohydrate", "total carbohydrates", "carbs"), "g|grams?"),
    "sugar": (("sugar", "total sugars", "added sugar", "added sugars", "natural added sugar"), "g|grams?"),
    "fat": (("fat", "total fat"), "g|grams?"),
    "saturated_fat": (("saturated fat", "saturated fats"), "g|grams?"),
    "fibre": (("fibre", "fiber", "dietary fibre", "dietary fiber"), "g|grams?"),
    "sodium": (("sodium",), "mg|milligrams?"),
}


def nutrition_tables(pages: DataFrame, id_column: str, html: str) -> DataFrame:
    """page, field, value of the one pipe table per 100 g of a page; pages with none or several, or without energy or protein, give no rows.

    Of several rows for one field the one whose name stands first in ``TABLE_ROWS`` counts, then the first.
    Lines are numbered, a header row opens a table, and a running count of headers names the table each row is in;
    all of it is built-in expressions, and the window runs within one page.
    """
    from pyspark.sql import Window

    lines = pages.select(F.col(id_column).alias("page"), F.posexplode(F.split(html_to_text(F.col(html)), "\n")).alias("nth", "line")).where(F.contains("line", F.lit("|")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select("page", "nth", cells.alias("cells")).where(F.size("cells") >= 2).withColumn("first", normalize_text(F.get("cells", F.lit(0))))
    head = F.col("first").isin("nutrient", "nutrition label")
    rows = rows.withColumn("nth_table", F.sum(head.cast("int")).over(Window.partitionBy("page").orderBy("nth"))).where(F.col("nth_table") > 0)
    at = F.array_position(F.transform("cells", lambda c: c.rlike(r"(?i)^per\s*100\s*g(?:rams?)?$")), F.lit(True))
    heads = rows.where(head).select("page", "nth_table", at.alias("at")).where(F.col("at") > 1)
    single = heads.groupBy("page").agg(F.count("*").alias("n"), F.min("nth_table").alias("nth_table"), F.min("at").alias("at")).where(F.col("n") == 1)
    body = rows.where(~head).join(single, ["page", "nth_table"]).withColumn("said", F.try_element_at("cells", F.col("at").cast("int")))
    field, value, rank = (F.lit(None).cast(t) for t in ("string", "double", "int"))
    for name, (names, units) in TABLE_ROWS.items():
        here = F.col("first").isin(*names)
        field = F.when(here, F.lit(name)).otherwise(field)
        value = F.when(here, F.regexp_extract("said", rf"(?i)^(\d+(?:\.\d+)?)\s*(?:{units})$", 1).try_cast("double")).otherwise(value)
        rank = F.when(here, F.array_position(F.array(*map(F.lit, names)), F.col("first")).cast("int")).otherwise(rank)
    told = body.select("page", "nth", field.alias("field"), value.alias("value"), rank.alias("rank")).where(F.col("field").isNotNull() & F.col("value").isNotNull())
    best = told.groupBy("page", "field").agg(F.min_by("value", F.struct("rank", "nth")).alias("value"))
    core = best.where(F.col("field").isin("calories", "protein")).groupBy("page").agg(F.count("*").alias("n")).where("n = 2").select("page")
    return best.join(core, "page", "left_semi")
