"""Freely typed values mapped to the entries of a canonical list, unmatched values reported."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from granary.llm.names import NameMatcher, common_words, entry_of, folded, forms_of
from granary.session import broadcast_if_small, cut_lineage, latest_by

_FORMS = ArrayType(StructType([StructField("form", StringType()), StructField("whole", BooleanType())]))
_RANKED = "text string, stage int, far double, spoiled double, form string, key string"


class CanonicalList:
    """The names and aliases of a list, ready to match texts with.

    Up to ``max_entries`` names go to the tasks as one automaton. A longer list is cut into blocks of that many
    forms: which words are common and which forms are ambiguous is decided over the whole list first, then each
    block ranks the distinct texts, and the best rank over all blocks counts, so the result is the same.
    """

    def __init__(self, entries: DataFrame, key: str, name: str, aliases: str, max_entries: int):
        each = entries.select(F.col(key).alias("key"), F.explode(F.concat(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("name"))
        self.names = cut_lineage(each.where(F.col("key").isNotNull() & F.col("name").isNotNull()).distinct())
        few = self.names.limit(max_entries + 1).collect()
        self.listed = [(r.key, r.name) for r in few] if len(few) <= max_entries else None
        self.max_entries = max_entries
        self.common = common_words(entry_of(n) for _, n in self.listed) if self.listed is not None else self._common()
        self._blocks: list[tuple[list, list]] | None = None

    def _entries(self) -> DataFrame:
        entry = F.pandas_udf(lambda names: names.map(entry_of), StringType())
        return self.names.select("key", entry("name").alias("entry")).where("entry <> ''").distinct()

    def _common(self) -> set[str]:
        """As ``common_words``, over a list of any length; only words of three names' first words go to the driver."""
        head = F.split_part("entry", F.lit(" "), F.lit(1))
        last = self._entries().groupBy(head.alias("head")).agg(F.max("entry").alias("entry"))
        words = last.select("head", F.explode(F.array_distinct(F.slice(F.split("entry", " "), 2, 1_000))).alias("word"))
        return {r.word for r in words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").collect()}

    def blocks(self) -> list[tuple[list, list]]:
        """(forms, entries) of each block, at most ``max_entries`` forms in one."""
        if self._blocks is None:
            common = self.common
            made = F.pandas_udf(lambda entries: entries.map(lambda e: [{"form": f, "whole": w} for f, w in forms_of(e, common)]), _FORMS)
            entries = cut_lineage(self._entries())
            owned = entries.select("key", F.inline(made("entry"))).groupBy("form").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.max("whole").alias("whole"))
            forms = cut_lineage(owned.where("key = last OR whole").select("form", "key"))
            count = 2 + 2 * max(forms.count(), entries.count()) // self.max_entries  # so that blocks of a hash stay below the bound
            block = lambda df, c, i: df.where(F.pmod(F.xxhash64(c), F.lit(count)) == i)
            self._blocks = [([(r.form, r.key) for r in block(forms, "form", i).collect()], [(r.entry, r.key) for r in block(entries, "entry", i).collect()]) for i in range(count)]
        return self._blocks

    def with_match(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """``rows`` with the key that ``text`` means, null if none; ``rows`` should have few repeats if the list is long."""
        if self.listed is not None:
            names, matcher = self.listed, []

            @F.pandas_udf(StringType())
            def means(values: pd.Series) -> pd.Series:
                if not matcher:
                    matcher.append(NameMatcher.of(names))
                return values.map(lambda v: matcher[0].match(v) if folded(v) else None)

            return rows.withColumn(out, means(text))
        found = self._ranked(rows.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct())
        return rows.join(broadcast_if_small(found.select(F.col("text").alias(text), F.col("key").alias(out))), text, "left")

    def _ranked(self, texts: DataFrame) -> DataFrame:
        texts, common = cut_lineage(texts), self.common

        def rank(part: tuple[list, list]):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                matcher = NameMatcher(*part, common)
                for batch in batches:
                    yield pd.DataFrame([(t, *r) for t in batch["text"] if folded(t) for r in matcher.best(t)], columns=[c.split()[0] for c in _RANKED.split(", ")])

            return run

        ranked = None
        for part in self.blocks():
            told = cut_lineage(texts.mapInPandas(rank(part), _RANKED))
            ranked = told if ranked is None else ranked.unionByName(told)
        even = ranked.groupBy("text", "stage", "far", "spoiled", "form").agg(F.min("key").alias("key"), F.max("key").alias("last"))
        best = even.groupBy("text").agg(F.min(F.struct("stage", "far", "spoiled", "form", "key", "last")).alias("b"))
        # of token sets that do equally well none is meant; of other ties the smallest key
        return cut_lineage(best.where("b.stage < 3 OR b.key = b.last").select("text", "b.key"))

    def squeezed(self, texts: DataFrame, text: str, out: str) -> DataFrame:
        """``texts`` with the key whose form, without spaces, is exactly ``text``; null if none."""
        if self.listed is not None:
            forms = sorted(NameMatcher.of(self.listed).squeezed.items())
        else:
            forms = sorted({f.replace(" ", ""): k for part in self.blocks() for f, k in sorted(part[0], reverse=True)}.items())
        told = texts.sparkSession.createDataFrame(forms, f"{text} string, {out} string")
        return texts.join(broadcast_if_small(told), text, "left")

    def words(self) -> DataFrame:
        """(word, key) of all words of all names."""
        return self._entries().select(F.explode(F.split("entry", " ")).alias("word"), "key").distinct()


def map_to_canonical(
    rows: DataFrame,
    entries: DataFrame,
    *,
    id_column: str = "listing_id",
    value: str = "brand",
    observed: str = "observed_at",
    ingested: str = "ingested_at",
    key: str = "brand_source_id",
    name: str = "brand_name",
    aliases: str = "brand_aliases",
    unmatched: str = "none",
    max_entries: int = 100_000,
) -> DataFrame:
    """The entry that each row's value means, or ``unmatched``.

    The automaton goes to the tasks with the function, so rows are mapped where they are, without a join on hot
    values; each task remembers values it has seen. The only shuffle makes rows delivered again one. A list of more
    than ``max_entries`` names is matched block by block with the distinct values, which are then joined.

    Defined cases: a null or blank value gives no row; a value without letters or digits is unmatched; of rows
    with one id the last observed, then last ingested counts; a null id gives no row; a name that two entries
    share means the smallest key; with an empty list every value is unmatched; other columns are ignored.
    """
    once = latest_by(
        rows.select(F.col(id_column).alias("id"), F.col(observed).alias("at"), F.col(ingested).alias("in"), F.col(value).alias("value")).where(F.col("id").isNotNull()),
        ["id"],
        ["at", "in"],
    )
    typed = once.where(F.regexp_replace("value", "[\\s\u00a0\u200b\ufeff]+", "") != "").select("id", "value")
    names = CanonicalList(entries, key, name, aliases, max_entries)
    told = names.with_match(typed if names.listed is not None else cut_lineage(typed), "value", "meant")
    return told.select(F.col("id").alias(id_column), F.coalesce("meant", F.lit(unmatched)).alias(key))
