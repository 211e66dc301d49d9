"""The pN_ queries of the general problems, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.packed import unpack_fields
from granary.operators.shred import flatten_payloads
from granary.operators.snapshots import snapshot_changes
from granary.operators.units import common_amounts, learned_factors, observations, pairwise_scales
from granary.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return unpack_fields(table(spark, folder, "label_products"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_payloads(table(spark, folder, "evidence_decisions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "snapshot_index"), table(spark, folder, "ingestion_runs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return common_amounts(table(spark, folder, "label_products"), table(spark, folder, "nutrient_values"))


def p6_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated scale, offset and known conversion between each two writings of units."""
    labels = table(spark, folder, "label_products").select("label_id", "net_quantity_text", "serving_size_text").distinct()
    texts = labels.select(
        "label_id", F.posexplode(F.array("net_quantity_text", "serving_size_text")).alias("field", "text")
    ).where(F.col("text").isNotNull())
    return pairwise_scales(observations(texts.select(F.struct("label_id", "field").alias("entity"), "text")))


def p6_factors(spark: SparkSession, folder: str) -> DataFrame:
    """The factor of each writing of a unit, and whether the graph or the table gave it."""
    return learned_factors(table(spark, folder, "label_products"), table(spark, folder, "nutrient_values"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p5_found, p6_found, p6_scales, p6_factors)}

ORACLE = {
    "p4_found": """
WITH RECURSIVE last AS (
  SELECT decision_id, arg_max(ltrim(payload, chr(65279)), (decided_at, payload)) AS t FROM evidence_decisions WHERE decision_id IS NOT NULL AND payload IS NOT NULL GROUP BY 1
), once AS (
  SELECT decision_id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM last
), whole AS (
  SELECT decision_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM once
), docs AS (
  SELECT decision_id, j, CASE WHEN json_type(j->'candidate') = 'OBJECT' THEN j->'candidate' ELSE j END AS c FROM whole WHERE json_type(j) = 'OBJECT'
), lists AS (
  SELECT decision_id, CASE json_type(j->'normalizedIngredients') WHEN 'ARRAY' THEN (j->'normalizedIngredients')::JSON[] WHEN 'OBJECT' THEN [j->'normalizedIngredients'] END AS l FROM docs
), nodes AS (
  SELECT decision_id, unnest(l) AS n, unnest(range(len(l)))::VARCHAR AS node_path, '' AS parent_path FROM lists
  UNION ALL
  SELECT decision_id, unnest(l), node_path || '.' || unnest(range(len(l)))::VARCHAR, node_path FROM (
    SELECT decision_id, node_path, CASE json_type(n->'children') WHEN 'ARRAY' THEN (n->'children')::JSON[] WHEN 'OBJECT' THEN [n->'children'] END AS l FROM nodes WHERE json_type(n) = 'OBJECT')
), boxes AS (
  SELECT decision_id, '' AS node_path, c->'boundingBox' AS b FROM docs
  UNION ALL
  SELECT decision_id, unnest(range(len(l)))::VARCHAR, unnest(l)->'boundingBox' FROM (SELECT decision_id, CASE json_type(c->'lines') WHEN 'ARRAY' THEN (c->'lines')::JSON[] WHEN 'OBJECT' THEN [c->'lines'] END AS l FROM docs)
), sides AS (
  SELECT decision_id, node_path, CASE json_type(b) WHEN 'ARRAY' THEN list_transform(b::JSON[], lambda x: try_cast(x->>'$' AS DOUBLE)) WHEN 'OBJECT' THEN list_transform(['x', 'y', 'width', 'height'], lambda k: try_cast(json_extract_string(b, k) AS DOUBLE)) END AS s FROM boxes
)
SELECT decision_id, 'ingredient' AS kind, node_path, parent_path, coalesce(CAST(floor(try_cast(n->>'position' AS DOUBLE) + 0.5) AS INT), -1) AS pos, CASE WHEN json_type(n) = 'OBJECT' THEN n->>'raw' ELSE n->>'$' END AS node_text FROM nodes WHERE json_type(n) <> 'NULL'
UNION ALL
SELECT decision_id, 'box', node_path, '', -1, array_to_string(list_transform(s, lambda x: CAST(floor(x + 0.5) AS BIGINT)::VARCHAR), ',') FROM sides WHERE len(s) = 4 AND len(list_filter(s, lambda x: x IS NULL)) = 0
""",
    "p5_found": """
WITH known AS (
  SELECT run_id, source_id AS src, row_number() OVER (PARTITION BY source_id ORDER BY started_at NULLS FIRST, run_id) AS nth
  FROM ingestion_runs WHERE source_complete
), keyed AS (
  SELECT run_id, trim(source_record_id) AS k, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h, loaded_at
  FROM snapshot_index
), held AS (
  SELECT src, nth, rec, arg_max(h, (loaded_at, h)) AS h FROM (
    SELECT src, nth, h, loaded_at,
      CASE WHEN regexp_full_match(k, '[0-9]+') AND length(k) < 14 THEN lpad(k, 14, '0') ELSE k END AS rec
    FROM keyed JOIN known USING (run_id))
  GROUP BY ALL
), diff AS (
  SELECT coalesce(a.src, b.src) AS src, coalesce(a.nth, b.nth + 1) AS nth, coalesce(a.rec, b.rec) AS source_record_id,
    CASE WHEN b.rec IS NULL THEN 'added' WHEN a.rec IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' END AS change_kind
  FROM held a FULL JOIN held b ON a.src = b.src AND a.nth = b.nth + 1 AND a.rec = b.rec
)
SELECT run_id, source_record_id, change_kind FROM diff JOIN known USING (src, nth) WHERE nth > 1 AND change_kind IS NOT NULL
""",
}
