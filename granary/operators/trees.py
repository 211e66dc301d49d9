"""Trees as adjacency rows, and ingredient statements parsed into trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from granary.functions.text import clean_tag, normalize_text
from granary.session import cut_lineage


def tree_paths(nodes: DataFrame, id_column: str, parent: str, max_depth: int = 64) -> DataFrame:
    """(id, depth, path) of all nodes reachable from roots (null parent), level by level; each level is one join.

    A node in a cycle is never reached; ``max_depth`` bounds the levels and raises if deeper nodes remain.
    """
    level = nodes.where(F.col(parent).isNull()).select(F.col(id_column).alias("id"), F.lit(0).alias("depth"), F.col(id_column).cast("string").alias("path"))
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(id_column).alias("child"), F.col(parent).alias("id"))
    found = level = cut_lineage(level)
    for _ in range(max_depth):
        level = cut_lineage(level.join(edges, "id").select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat_ws(">", "path", F.col("child").cast("string")).alias("path")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"the tree is deeper than {max_depth}")


_MARKS = re.compile(r"[(\[]|[)\]]|[,;&]")


def split_top_level(text: str, ampersands: bool = True) -> list[str]:
    """Parts between commas, semicolons and (unless after '-') ampersands that stand outside brackets, without those that are blank."""
    marks = [(m.start(), m[0]) for m in _MARKS.finditer(text)]
    steps = np.array([1 if c in "([" else -1 if c in ")]" else 0 for _, c in marks], dtype=int)
    sums = np.cumsum(steps)
    depths = sums - np.minimum(np.minimum.accumulate(sums), 0) if len(marks) else sums  # a closing bracket too many doesn't count
    ends = [at for (at, c), depth in zip(marks, depths) if depth == 0 and (c in ",;" or (c == "&" and ampersands and not text[:at].rstrip().endswith("-")))]
    parts = [text[a:b].strip() for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(text)])]
    return [p for p in parts if p]


def bracketed(part: str) -> str | None:
    """What stands in the brackets that end a part which begins with something else."""
    opens = re.search(r"[(\[]", part)
    return part[opens.end() : -1] if opens and opens.start() > 0 and part.endswith((")", "]")) and len(part) > opens.end() + 1 else None


def _nodes(raw: str, ampersands: bool) -> Iterator[tuple[str, str, int, str]]:
    """(path, parent path, position, raw) of all nodes, level by level."""
    level = [("", raw)]
    while level:
        below = []
        for parent, text in level:
            for position, part in enumerate(split_top_level(text, ampersands)):
                path = f"{parent}.{position}" if parent else str(position)
                yield path, parent, position, part
                if (inner := bracketed(part)) is not None:
                    below.append((path, inner))
        level = below


def ingredient_nodes(df: DataFrame, id_column: str, text: str, ampersands: bool = True) -> DataFrame:
    """id, path, parent_path, position, raw, name, percentage of each node of an ingredient statement.

    The bracket grammar runs as one Arrow function per batch; names and percentages are built-in expressions.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *node) for key, value in zip(batch["id"], batch["text"]) for node in _nodes(value, ampersands)]
            yield pd.DataFrame(rows, columns=["id", "path", "parent_path", "position", "raw"])

    texts = df.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).where(F.trim(F.col("text")) != "")
    nodes = texts.mapInPandas(parse, "id string, path string, parent_path string, position int, raw string")
    ends = F.col("raw").rlike(r"[^(\[]+[(\[].+[)\]]$")
    stem = F.when(ends, F.regexp_extract("raw", r"^[^(\[]+", 0)).otherwise(F.col("raw"))
    name = normalize_text(F.regexp_replace(stem, r"\d+(?:\.\d+)?\s*%", ""))
    said = F.regexp_extract("raw", r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    return nodes.withColumn("name", F.nullif(name, F.lit(""))).withColumn("percentage", F.when(said <= 100, said))


def rebuild_trees(nodes: DataFrame, id_column: str) -> DataFrame:
    """(id, tree): the nested JSON array of each id's nodes (id, path, parent_path, position, raw), children in order of position.

    A record's nodes are few and gathered per record; nodes without their parent are left out.
    """
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = []
            for told in batch["nodes"]:
                made = {n["path"]: {"raw": n["raw"], "position": int(n["position"]), "children": []} for n in told}
                roots: list[dict] = []
                for n in sorted(told, key=lambda n: (n["position"], n["path"])):
                    if n["parent_path"] == "" or n["parent_path"] in made:
                        (roots if n["parent_path"] == "" else made[n["parent_path"]]["children"]).append(made[n["path"]])
                trees.append(json.dumps(roots, ensure_ascii=False, separators=(",", ":")))
            yield pd.DataFrame({"id": batch["id"], "tree": trees})

    gathered = nodes.groupBy(F.col(id_column).cast("string").alias("id")).agg(F.collect_list(F.struct("path", "parent_path", "position", "raw")).alias("nodes"))
    return gathered.mapInPandas(build, "id string, tree string")


@F.pandas_udf(ArrayType(StringType()))
def _top_level(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_top_level(t) if t is not None else None)


def declared_allergens(df: DataFrame, id_column: str, contains: str, traces: str) -> DataFrame:
    """(id, name, declaration) of every part of two allergen texts outside brackets; what is in brackets belongs to its part's name."""

    def parts(column: str, kind: str) -> DataFrame:
        said = df.where(F.col(column).isNotNull()).select(F.col(id_column).alias("id"), F.explode(_top_level(F.col(column))).alias("part"))
        return said.select("id", clean_tag(F.col("part")).alias("name"), F.lit(kind).alias("declaration"))

    return allergen_declarations(parts(contains, "contains").unionByName(parts(traces, "may_contain")))


def allergen_declarations(parts: DataFrame) -> DataFrame:
    """(id, name, declaration) from (id, name, declaration) rows of contains, may_contain and source_tag.

    Repeats count once; a tag counts only if no other declaration of the id has its name.
    """
    once = parts.where(F.col("name") != "").distinct()
    told = once.where(F.col("declaration") != "source_tag")
    return told.unionByName(once.where(F.col("declaration") == "source_tag").join(told.select("id", "name"), ["id", "name"], "left_anti"))
