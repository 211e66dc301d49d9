"""The pN_ queries of the problems tagged llm, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.canonical import map_to_canonical
from granary.llm.leaks import leaked_items
from granary.llm.mixing import mix
from granary.llm.resolve import product_pairs, same_products
from granary.llm.spam import spam_pages
from granary.llm.survivors import claims_of, discover_truth, surviving_values
from granary.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return product_pairs(same_products(table(spark, folder, "listings"), table(spark, folder, "brand_sources")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return map_to_canonical(table(spark, folder, "listings"), table(spark, folder, "brand_sources"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_values(table(spark, folder, "source_records"), table(spark, folder, "sources"))


def p7_truth(spark: SparkSession, folder: str) -> DataFrame:
    """The best supported value of each product and field under truth discovery."""
    truth, _ = discover_truth(claims_of(table(spark, folder, "source_records")))
    return truth.select(F.col("g").alias("product_id"), F.col("field").alias("field_name"), "value", F.col("r").alias("record_id"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of the report on the whole mix, drawn as in ``p9_mix``."""
    return _mixed(spark, folder)[1].where("short").select("source")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chances of one more copy in proportion to a document's tokens."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), weight=F.greatest("tokens", F.lit(1)))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(table(spark, folder, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p7_found, p7_truth, p8_found, p9_found, p9_mix, p9_shares, p10_found)}

_USABLE = {
    **{f: f"lower(trim({f})) NOT IN ('', '-', 'n/a', 'tbd', 'unknown', 'not available', 'null', 'none', 'na', 'nil')" for f in ("brand", "item_name", "flavour", "ingredients_raw")},
    **{f: f"{f} >= 0" for f in ("net_quantity_grams", "serving_size_grams", "calories", "protein_grams")},
}
ORACLE = {
    "p7_found": f"""
WITH plain AS (
  SELECT DISTINCT product_id, record_id, lower(trim(nutrition_status)) = 'verified' AS verified, lower(trim(source_id)) AS src,
    CASE WHEN regexp_full_match(trim(evidence_observed_at), '[0-9]+') THEN trim(evidence_observed_at)::BIGINT * 1000000
         ELSE epoch_us(evidence_observed_at::TIMESTAMPTZ) END AS seen,
    {', '.join(f'coalesce({sql}, false) AS u_{f}' for f, sql in _USABLE.items())}
  FROM source_records
), ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY product_id ORDER BY verified DESC, coalesce(nutrition_authority, 0) DESC, seen DESC NULLS LAST,
    {' + '.join(f'u_{f}::INT' for f in _USABLE)} DESC, record_id) AS nth, count(*) OVER (PARTITION BY product_id) AS n
  FROM plain p LEFT JOIN sources s ON s.source_id = p.src
)
SELECT product_id, 'record' AS field_name, record_id FROM ranked WHERE n > 1 AND nth = 1
{''.join(f" UNION ALL SELECT product_id, '{f}', arg_min(record_id, nth) FROM ranked WHERE n > 1 AND u_{f} GROUP BY product_id" for f in _USABLE)}
""",
    # words and signs stand for tokens: which sources fall short is the same for any usual tokenizer
    "p9_found": r"""
WITH sized AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]'))) AS n
  FROM (SELECT DISTINCT doc_id, source, text FROM documents) SEMI JOIN mix_targets USING (source) GROUP BY source
)
SELECT m.source FROM mix_targets m LEFT JOIN sized USING (source) WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(n) FROM sized)
""",
}
