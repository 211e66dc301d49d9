"""Words within a few edits of each other, found by joins on deletion neighbourhoods instead of comparing all with all.

Two words within k edits (a swap of neighbours is one) are equal after at most k letters are left out of each. So each
word is spelled out with up to k letters left out, equal spellings meet in a join, and the pairs met are then checked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from granary.llm.names import allowed_edits, edits

SHORTEST, LONGEST = 5, 24


def _one_left_out(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def spellings(word: Column, most: Column) -> Column:
    """The distinct spellings of a word with up to ``most`` (0 to 2) letters left out."""
    once = F.when(most >= 1, _one_left_out(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when(most >= 2, F.flatten(F.transform(once, _one_left_out))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def edits_allowed(length: Column) -> Column:
    """``names.allowed_edits`` as an expression."""
    return F.when(length >= 7, 2).when(length >= 5, 1).otherwise(0)


@F.pandas_udf(IntegerType())
def _distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([edits(a, b, allowed_edits(len(b))) for a, b in zip(left, right)], dtype="int32")


def near_pairs(words: DataFrame, targets: DataFrame, ratio: float) -> DataFrame:
    """(word, target, weight, far) of each word (word, n) and target (target, weight) within the edits a target's length allows.

    Only targets that weigh more than ``ratio`` times the word count; a word is no target of itself. Words of fewer
    than five or more than 24 letters have no neighbours: they are compared as they are written.
    """
    fit = lambda c: F.length(c).between(SHORTEST, LONGEST)
    left = words.where(fit("word")).select("word", "n", F.explode(spellings(F.col("word"), F.lit(2))).alias("spelling"))
    right = targets.where(fit("target")).select("target", "weight", F.explode(spellings(F.col("target"), edits_allowed(F.length("target")))).alias("spelling"))
    met = left.join(right, "spelling").where((F.col("weight") > ratio * F.col("n")) & (F.col("word") != F.col("target"))).select("word", "target", "weight").distinct()
    return met.withColumn("far", _distance("word", "target")).where(F.col("far") <= edits_allowed(F.length("target")))
