"""Mixing sources to target shares of the total size in tokens, by Pareto order sampling."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import broadcast_if_small, cut_lineage

TOKENIZER = os.environ.get("GRANARY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how byte-level BPE of this kind cuts a text before merging.
_CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BUCKETS = 1 << 16


def token_count(spark: SparkSession, path: str = TOKENIZER):
    """A vectorised function from text to its number of tokens under the rank file at ``path``; 0 for null.

    The file is sent to the executors, which need no path of their own to it.
    """
    loaded: list = []
    name = os.path.basename(path)
    spark.sparkContext.addFile(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not loaded:
            import tiktoken

            with open(SparkFiles.get(name), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
            loaded.append(tiktoken.Encoding("ranks", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={}))
        encode = loaded[0].encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def sized_documents(documents: DataFrame, targets: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc, src, tokens of the documents whose source is listed, each id once. Only these three columns are shuffled."""
    listed = broadcast_if_small(targets.select(F.col(source).alias("src")).where(F.col("src").isNotNull()).distinct())
    held = documents.select(F.col(doc).alias("doc"), F.col(source).alias("src"), F.col(text).alias("text")).where(F.col("doc").isNotNull()).join(listed, "src", "left_semi")
    counted = held.select("doc", "src", token_count(documents.sparkSession, tokenizer)("text").alias("tokens"))
    return cut_lineage(counted.groupBy("doc").agg(F.max(F.struct("src", "tokens")).alias("m")).select("doc", "m.src", "m.tokens"))


def allocate(sized: DataFrame, targets: DataFrame, *, source: str = "source", share: str = "target_share", repeats: str = "max_repeats") -> DataFrame:
    """Per listed source: its size, target, certain whole copies of all its documents, the rest to sample, and whether it falls short."""
    wanted = targets.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("src")).agg(F.max(share).alias("share"), F.max(repeats).alias("most"))
    sizes = sized.groupBy("src").agg(F.sum("tokens").alias("size"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).scalar()
    joined = wanted.join(sizes, "src", "left").fillna(0, ["size", "share", "most"])
    target = F.col("share") * total
    copies = F.when(F.col("size") > 0, F.least(F.floor(F.try_divide(target, F.col("size"))), F.col("most").cast("long"))).otherwise(F.lit(0))
    rest = F.when((F.col("copies") < F.col("most")) & (F.col("size") > 0), target - F.col("copies") * F.col("size")).otherwise(F.lit(0.0))
    return cut_lineage(joined.withColumn("target", target).withColumn("copies", copies).withColumn("rest", rest).withColumn("short", F.col("size") * F.col("most") < target))


def _uniform(doc: Column, seed: int) -> Column:
    """A number within (0, 1) that depends on the document's id and the seed only."""
    return (F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def inclusion(sized: DataFrame, plan: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Adds pi, the chance of one more copy: proportional to ``weight``, at most 1, so that the expected tokens are the source's rest.

    Documents whose share would pass 1 are certain; the others share what remains, until no further one passes 1;
    an error if that takes more than ``max_rounds``.
    """
    docs = sized.join(broadcast_if_small(plan.where(F.col("rest") > 0).select("src", "rest")), "src")
    scale = None
    for _ in range(max_rounds):
        if scale is None:
            sure = F.lit(False)
            with_scale = docs
        else:
            with_scale = docs.join(broadcast_if_small(scale), "src")
            sure = F.col("weight") * F.col("scale") >= 1
        open_tokens = F.sum(F.when(~sure, F.col("weight") * F.col("tokens")).otherwise(0.0))
        sure_tokens = F.sum(F.when(sure, F.col("tokens")).otherwise(0))
        new = with_scale.groupBy("src").agg(F.try_divide(F.first("rest") - sure_tokens, open_tokens).alias("scale"), F.sum(sure.cast("int")).alias("certain"))
        new = cut_lineage(new.withColumn("scale", F.coalesce("scale", F.lit(float("inf")))))
        if scale is not None and new.join(scale.select("src", F.col("certain").alias("before")), "src").where(F.col("certain") != F.col("before")).isEmpty():
            break
        scale = new
        if docs.select(F.max("weight") == F.min("weight")).first()[0]:
            break
    else:
        raise RuntimeError(f"the inclusion chances still change after {max_rounds} rounds")
    return docs.join(broadcast_if_small(scale.select("src", "scale")), "src").withColumn("pi", F.least(F.col("weight") * F.col("scale"), F.lit(1.0)))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    seed: int = 17,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of the chosen documents, and a report per listed source.

    Each source gets as many whole copies of all its documents as fit into its target; what remains is drawn by
    Pareto order sampling: documents are ranked by (u / (1 - u)) / (pi / (1 - pi)) and taken in that order until
    the rest is filled to the nearest document. The cut is found from a histogram of ranks with a fixed number of
    bins per source; only the documents of the one bin that holds it are ordered, so a source of any size needs no
    task of its own. ``weight`` (of the columns src, doc, tokens; default all equal) makes the chances unequal.

    Defined cases: documents of unlisted sources take no part; a listed source without documents, or too small even
    with all repeats, falls short and gives what it has; null and empty texts have no tokens; ids that repeat count
    once; a null target share or repeat count is 0; ties of rank go by id; other columns are ignored.
    """
    sized = sized_documents(documents, targets, doc=doc, text=text, source=source, tokenizer=tokenizer)
    plan = allocate(sized, targets, source=source)
    drawn = inclusion(sized.withColumn("weight", (F.lit(1.0) if weight is None else weight).cast("double")), plan)
    u = _uniform(F.col("doc"), seed)
    odds = F.when(F.col("pi") >= 1, F.lit(0.0)).when(F.col("pi") <= 0, F.lit(float("inf"))).otherwise((u / (1 - u)) / (F.col("pi") / (1 - F.col("pi"))))
    ranked = drawn.withColumn("rank", odds).withColumn("bin", F.when(F.col("rank") == float("inf"), F.lit(_BUCKETS)).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * _BUCKETS)))
    bins = ranked.groupBy("src", "bin", "rest").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = bins.withColumn("before", F.coalesce(F.sum("tokens").over(running), F.lit(0))).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
    cut = broadcast_if_small(cut_lineage(cut.select("src", F.col("bin").alias("cut"), "before")))
    placed = ranked.join(cut, "src", "left")
    sure = placed.where(F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    order = Window.partitionBy("src").orderBy("rank", "doc").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where(F.col("bin") == F.col("cut")).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    last = last.where(F.col("at") + F.col("tokens") / 2 <= F.col("rest"))
    extra = sure.select("doc").unionByName(last.select("doc")).withColumn("one", F.lit(1))
    whole = broadcast_if_small(plan.select("src", F.col("copies").alias("whole")))
    chosen = sized.join(whole, "src").join(extra, "doc", "left").withColumn("copies", (F.col("whole") + F.coalesce("one", F.lit(0))).cast("int")).where(F.col("copies") > 0)
    chosen = cut_lineage(chosen.select(F.col("doc").alias("doc_id"), F.col("src").alias("source"), "tokens", "copies"))
    used = chosen.groupBy(F.col("source").alias("src")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    all_used = chosen.agg(F.coalesce(F.sum(F.col("tokens") * F.col("copies")), F.lit(0)).alias("all_used")).scalar()
    report = plan.join(used, "src", "left").select(
        F.col("src").alias("source"), F.col("share").alias("target_share"), F.col("size").alias("source_tokens"), F.coalesce("used", F.lit(0)).alias("used_tokens"),
        F.coalesce(F.try_divide(F.col("used"), all_used), F.lit(0.0)).alias("actual_share"), "short",
    )
    return chosen, report


def short_sources(documents: DataFrame, targets: DataFrame, *, source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """The listed sources that even all repeats can't fill to their target; the first stage of ``mix``."""
    plan = allocate(sized_documents(documents, targets, source=source, tokenizer=tokenizer), targets, source=source)
    return plan.where("short").select(F.col("src").alias("source"))
