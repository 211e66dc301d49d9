"""What the words of listings mean, learned from all listings by aggregates and joins; nothing of it goes to the driver.

The dictionary has one row per (role, text) that says anything: brand fields, words, two words as one, flavours. Words
that are a few edits from a much more frequent word are its typing errors.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.llm.listings import BRAND, FLAVOUR, JOINED, PLAIN, WORD
from granary.llm.canonical import CanonicalList
from granary.llm.names import _AROUND, folded, unleeted
from granary.llm.near import near_pairs
from granary.session import broadcast_if_small, cut_lineage

# What stands in a brand field that names no brand.
NO_BRAND = frozenset(("", "n a", "na", "none", "null", "nil", "unknown", "generic", "unbranded", "retail partner", "no brand", "not available", "not applicable", "tbd", "other", "others", "various", "imported", "local"))
_SMALL = 200_000


def bare_brand(text: str | None) -> str:
    return " ".join(w for w in unleeted(folded(text)).split() if w not in _AROUND)


def _weighs(ratio: int) -> Column:
    """A word in one or two listings is a typing error of any neighbour in three; one in more, of a neighbour in ``ratio`` times as many."""
    return F.when(F.col("n") < 3, F.lit(2)).otherwise(ratio * F.col("n"))


def _nearest(words: DataFrame, targets: DataFrame, ratio: int) -> DataFrame:
    """(word, target, vague): the nearest target of each word that has any, the heaviest of several as near.

    It is vague, without a target, if the others as near weigh more than a ``ratio``-th of the heaviest.
    """
    pairs = near_pairs(words.withColumn("n", _weighs(ratio)), targets, 1)
    ranked = pairs.groupBy("word", "far").agg(F.max(F.struct("weight", "target")).alias("top"), F.sum("weight").alias("all"))
    best = ranked.groupBy("word").agg(F.min(F.struct("far", "top", "all")).alias("m")).select("word", "m.top", "m.all")
    vague = (F.col("all") - F.col("top.weight")) * ratio > F.col("top.weight")
    return best.select("word", F.when(~vague, F.col("top.target")).alias("target"), vague.alias("vague"))


def _flavours(tokens: DataFrame) -> DataFrame:
    """(role, text, flavour): each flavour that two flavour fields say, in the writing of its more frequent words."""
    said = cut_lineage(tokens.where((F.col("role") == FLAVOUR) & F.col("own")).groupBy("text").agg(F.sum("n").alias("n")).where("n > 1"))
    words = said.select("text", "n", F.posexplode(F.split("text", " ")).alias("at", "word"))
    counted = cut_lineage(words.groupBy("word").agg(F.sum("n").alias("n")))
    typed = _nearest(counted, counted.select(F.col("word").alias("target"), F.col("n").alias("weight")), 2).where("target IS NOT NULL")
    mended = words.join(broadcast_if_small(cut_lineage(typed)), "word", "left").groupBy("text").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("target", "word"))), " ").alias("flavour"))
    return cut_lineage(mended.select(F.lit(FLAVOUR).alias("role"), "text", "flavour"))


def learn_dictionary(tokens: DataFrame, known: CanonicalList, ratio: int = 5) -> DataFrame:
    """(role, text, line, maker, flavour, spelled, explained, vague, weight) from (role, text, own, n).

    ``tokens`` has one row per role and text, with the number of listings; ``own`` tells a flavour field's flavour
    from one that a title's words may make up. ``known`` is the canonical list of brands.
    A word means, in this order: a brand whose name it is in; a more frequent word that it is a typing error of; a
    brand that it nearly names, unless it is more frequent than that brand's own words; a product line. ``spelled`` is
    the ordinary word, ``flavour`` the flavour, that a word is a typing error of.
    """
    spark = tokens.sparkSession
    common = known.common

    @F.pandas_udf(StringType())
    def bare(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            name = bare_brand(text)
            own = [w for w in name.split() if w not in common]
            if len(own) == 1:  # 'SomeFoods' is 'Some Foods'
                end = max((c for c in common if len(c) >= 4 and own[0].endswith(c) and len(own[0]) >= len(c) + 5), key=len, default="")
                own = [own[0].removesuffix(end)]
            return None if name in NO_BRAND else " ".join(own) if own else name

        return texts.map(one)

    flavours = _flavours(tokens)
    flavour_words = flavours.select(F.explode(F.split(F.concat_ws(" ", "text", "flavour"), " ")).alias("word")).distinct()

    # brand fields: the list's brands, else their own bare writing, or that of a more frequent neighbour
    fields = cut_lineage(known.with_match(tokens.where(F.col("role") == BRAND).select("text", "n"), "text", "listed").withColumn("bare", bare("text")))
    heads = fields.where("listed IS NULL AND bare IS NOT NULL").select("text", "n", "bare", F.replace("bare", F.lit(" "), F.lit("")).alias("word"))
    counted = cut_lineage(heads.groupBy("word").agg(F.sum("n").alias("n"), F.min("bare").alias("bare")))
    mended = _nearest(counted, counted.select(F.col("word").alias("target"), F.col("n").alias("weight")), 2).where("target IS NOT NULL")
    own = cut_lineage(counted.join(mended.select("word", "target"), "word", "left").select("word", "n", "bare", F.concat(F.lit("~"), F.coalesce("target", "word")).alias("maker")))
    brands = fields.join(own.select(F.replace("bare", F.lit(" "), F.lit("")).alias("word"), F.col("maker").alias("unlisted")), F.replace("bare", F.lit(" "), F.lit("")) == F.col("word"), "left")
    brands = brands.select(F.lit(BRAND).alias("role"), "text", F.coalesce("listed", "unlisted").alias("maker")).where(F.col("maker").isNotNull())

    # the forms of unlisted brands in titles: the whole, and a first word that no other of them begins with
    begins = own.where(F.contains("bare", F.lit(" "))).groupBy(F.split_part("bare", F.lit(" "), F.lit(1)).alias("word")).agg(F.min("maker").alias("maker"), F.max("maker").alias("last"), F.sum("n").alias("n"))
    forms = own.where(F.length("word") >= 5).select("word", "maker", "n").unionByName(begins.where((F.col("maker") == F.col("last")) & (F.length("word") >= 5)).select("word", "maker", "n"))
    forms = cut_lineage(forms.groupBy("word").agg(F.max(F.struct("n", "maker")).alias("m")).select("word", "m.maker", F.col("m.n").alias("held")))

    # words
    listed_words = cut_lineage(known.words())
    plain = F.broadcast(spark.createDataFrame([(w,) for w in sorted(PLAIN)], "word string").withColumn("plain", F.lit(True)))
    tasted = tokens.where((F.col("role") == FLAVOUR) & F.col("own")).join(broadcast_if_small(flavours.select("text")), "text", "left_semi").select(F.explode(F.split("text", " ")).alias("word"), "n")
    seen = cut_lineage(tokens.where(F.col("role") == WORD).select(F.col("text").alias("word"), "n").unionByName(tasted).groupBy("word").agg(F.sum("n").alias("n")))
    weights = broadcast_if_small(cut_lineage(listed_words.join(seen, "word").groupBy("key").agg(F.max("n").alias("heaviest"))), _SMALL)
    named = listed_words.select("word").distinct().withColumn("named", F.lit(True))
    words = seen.join(plain, "word", "left").join(flavour_words.withColumn("tastes", F.lit(True)), "word", "left").join(named, "word", "left").join(forms, "word", "left")
    words = known.with_match(words.withColumn("typed", F.when(F.length("word") >= 5, F.col("word"))), "typed", "listed")
    words = cut_lineage(words.drop("typed"))
    clear = F.col("plain").isNotNull() | F.col("tastes").isNotNull() | F.col("named").isNotNull() | (F.col("maker").isNotNull() & (F.col("held") >= F.col("n") / 2))
    targets = words.select(F.col("word").alias("target"), F.col("n").alias("weight")).unionByName(forms.select(F.col("word").alias("target"), F.col("held").alias("weight"))).groupBy("target").agg(F.max("weight").alias("weight"))
    near = cut_lineage(_nearest(words.where(~clear).select("word", "n"), targets, ratio))
    # a target may itself be a typing error of another: one step further
    steps = near.join(near.select(F.col("word").alias("target"), F.col("target").alias("further")), "target", "left").select("word", F.coalesce("further", "target").alias("target"), "vague")

    def meaning(of: str) -> list[Column]:
        """Line, maker, explained of a word that is no typing error."""
        explained = F.col(f"{of}.plain").isNotNull() | F.col(f"{of}.tastes").isNotNull()
        brand = F.coalesce(
            F.when(F.col(f"{of}.named").isNotNull(), F.col(f"{of}.listed")),
            F.when(F.col(f"{of}.held") >= F.col(f"{of}.n") / 2, F.col(f"{of}.maker")),
            F.when(F.coalesce(F.col(f"{of}.heaviest"), F.lit(0)) >= F.col(f"{of}.n"), F.col(f"{of}.listed")),
        )
        line = F.when(~explained & F.col(f"{of}.named").isNull() & brand.isNull(), F.col(f"{of}.word"))
        return [line, F.when(~explained, brand), explained | F.col(f"{of}.named").isNotNull() | brand.isNotNull()]

    words = words.join(weights.withColumnRenamed("key", "listed"), "listed", "left")
    met = words.alias("w").join(steps.alias("s"), F.col("w.word") == F.col("s.word"), "left").join(words.alias("t"), F.col("s.target") == F.col("t.word"), "left").join(forms.alias("f"), F.col("s.target") == F.col("f.word"), "left")
    by_form = F.col("t.word").isNull() & F.col("f.word").isNotNull()
    choose = [F.when(F.col("t.word").isNotNull(), t).otherwise(w) for t, w in zip(meaning("t"), meaning("w"))]
    vague = F.coalesce("s.vague", F.lit(False)) & choose[1].isNull()
    told = met.select(
        F.lit(WORD).alias("role"), F.col("w.word").alias("text"), F.when(F.col("t.plain").isNotNull(), F.col("t.word")).alias("spelled"), F.when(F.col("t.tastes").isNotNull(), F.col("t.word")).alias("taste"), F.when(~by_form & ~vague, choose[0]).alias("line"), F.when(by_form, F.col("f.maker")).otherwise(choose[1]).alias("maker"),
        (by_form | choose[2]).alias("explained"), vague.alias("vague"), F.col("w.n").alias("n"),
    )
    told = cut_lineage(told)
    weight = told.where("line IS NOT NULL").groupBy("line").agg(F.sum("n").alias("weight"))
    told = told.join(weight, "line", "left").join(broadcast_if_small(flavours.select(F.col("text").alias("taste"), "flavour")), "taste", "left")
    told = told.select("role", "text", "line", "maker", "flavour", "spelled", "explained", "vague", F.coalesce("weight", "n").alias("weight"))

    # two words as one: only those that are written as a line or brand elsewhere
    joined = tokens.where(F.col("role") == JOINED).select("text", "n").join(told.where("line = text AND weight > 2").select("text", "line", "weight"), "text", "left").join(forms.select(F.col("word").alias("text"), "maker"), "text", "left")
    joined = known.squeezed(joined, "text", "exact").withColumn("maker", F.coalesce("exact", "maker")).where((F.col("line").isNotNull() & (F.col("weight") > 5 * F.col("n"))) | F.col("maker").isNotNull())
    joined = joined.select(F.lit(JOINED).alias("role"), "text", F.when(F.col("maker").isNull(), F.col("line")).alias("line"), "maker", "weight")
    return cut_lineage(told.unionByName(joined, True).unionByName(brands, True).unionByName(flavours, True).select("role", "text", "line", "maker", "flavour", "spelled", F.coalesce("explained", F.lit(False)).alias("explained"), F.coalesce("vague", F.lit(False)).alias("vague"), F.coalesce("weight", F.lit(0)).alias("weight")))


def mark_companions(dictionary: DataFrame, looked: DataFrame, most: float = 0.5) -> DataFrame:
    """The dictionary with those lines explained that mostly stand beside another in a title: a title names one line, ordinary words come with others.

    ``looked`` is (id, role, text), one row per listing and text looked up.
    """
    lines = looked.where(F.col("role") == WORD).join(broadcast_if_small(dictionary.where("role = 'w' AND line IS NOT NULL AND NOT explained").select("role", "text", "line"), _SMALL), ["role", "text"])
    sets = lines.groupBy("id").agg(F.collect_set("line").alias("lines"))  # at most the words of one title
    shares = sets.select(F.size("lines").alias("k"), F.explode("lines").alias("line")).groupBy("line").agg(F.avg((F.col("k") > 1).cast("int")).alias("beside"))
    beside = broadcast_if_small(cut_lineage(shares.where(F.col("beside") > most).select("line", F.lit(True).alias("companion"))), _SMALL)
    marked = dictionary.join(beside, "line", "left")
    return cut_lineage(marked.select("role", "text", "line", "maker", "flavour", "spelled", (F.col("explained") | F.coalesce("companion", F.lit(False))).alias("explained"), "vague", "weight"))
