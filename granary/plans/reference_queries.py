"""One query per operator of the survey, over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import nutrition as nu
from granary.functions import text as tx
from granary.functions import times
from granary.functions.jsons import changed_fields, compact, sorted_unique
from granary.operators import ledgers, relational as rel, trees, upserts
from granary.operators.entities import keyed, resolve_entities
from granary.operators.label_rows import align_rows, lines_of_payloads
from granary.session import broadcast_if_small, latest_by
from granary.sources.files import histogram, manifest, stage
from granary.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# The rows of source_records, each record once (as last ingested), with sources and statuses in one writing.
_RECORDS = """records AS (
  SELECT record_id, product_id, lower(trim(source_id)) AS source_id, lower(trim(nutrition_status)) AS status, brand, item_name, flavour,
    net_quantity_grams, serving_size_grams, ingredients_raw, calories, protein_grams, content_hash, ingested_at
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS nth_delivery FROM source_records) WHERE nth_delivery = 1
)"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    tidy = lambda c: F.lower(F.trim(c)).alias
    rows = table(spark, folder, "source_records").select(
        "record_id", "product_id", tidy("source_id")("source_id"), tidy("nutrition_status")("status"), "brand", "item_name", "flavour",
        "net_quantity_grams", "serving_size_grams", "ingredients_raw", "calories", "protein_grams", "content_hash", "ingested_at",
    )
    return latest_by(rows, ["record_id"], ["ingested_at"])


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return broadcast_if_small(table(spark, folder, "sources"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "label_products").distinct()


def _flat(**metrics: Column) -> list[Column]:
    return [c for name, m in metrics.items() for c in (F.round(m["value"], 6).alias(name), m["reason"].alias(f"{name}_reason"))]


# --- projections, filters, search -------------------------------------------------------------------------------

_TOP = """best AS (
  SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(nutrition_authority, 0) DESC, ingested_at DESC, record_id) AS nth
    FROM records r LEFT JOIN sources s USING (source_id)) WHERE nth = 1
)"""
_BEST = f"{_RECORDS}, {_TOP}"


def _best(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _records(spark, folder).join(_sources(spark, folder).select("source_id", "nutrition_authority", "source_kind"), "source_id", "left")
    keep = ["record_id", "source_id", "source_kind", "status", "brand", "item_name", "flavour", "net_quantity_grams", "serving_size_grams", "calories", "protein_grams", "content_hash"]
    return rel.top1(ranked, ["product_id"], [F.coalesce("nutrition_authority", F.lit(0)), F.col("ingested_at"), -F.col("record_id")], keep)


@query(f"""WITH {_BEST}, found AS (
  SELECT product_id, record_id, brand, item_name, status,
    CASE WHEN calories > 0 AND protein_grams * 4 <= calories THEN round(protein_grams * 100 / calories, 6) END AS density
  FROM best WHERE coalesce(contains(lower(item_name), 'protein'), false)
)
SELECT *, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS pages
FROM found ORDER BY density DESC NULLS LAST, item_name NULLS FIRST, product_id LIMIT 50""")
def catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    found = rel.search(_best(spark, folder), "protein", ["item_name"])
    usable = (F.col("calories") > 0) & (F.col("protein_grams") * 4 <= F.col("calories"))
    density = F.when(usable, F.round(F.col("protein_grams") * 100 / F.col("calories"), 6))
    shown = found.select("product_id", "record_id", "brand", "item_name", "status", density.alias("density"))
    return rel.page(shown, [F.desc_nulls_last("density"), F.asc_nulls_first("item_name"), F.asc("product_id")], 1, 50)


@query("""SELECT DISTINCT label_id, brand, item_name FROM label_products
WHERE (contains(lower(brand), 'protein') OR contains(lower(item_name), 'protein') OR coalesce(contains(lower(flavour), 'protein'), false) OR contains(lower(category), 'protein'))
  AND (contains(lower(brand), 'chocolate') OR contains(lower(item_name), 'chocolate') OR coalesce(contains(lower(flavour), 'chocolate'), false) OR contains(lower(category), 'chocolate'))""")
def search_terms(spark: SparkSession, folder: str) -> DataFrame:
    return rel.search(_labels(spark, folder), "Protein chocolate", ["brand", "item_name", "flavour", "category"]).select("label_id", "brand", "item_name").distinct()


@query(f"""WITH {_RECORDS}, seen AS (
  SELECT product_id, bool_or(status = 'verified' AND coalesce(nutrition_authority, 0) >= 90) AS labelled, bool_or(status = 'verified') AS verified,
    bool_or(status = 'conflict') AS conflict, bool_or(calories IS NOT NULL) AS stated
  FROM records LEFT JOIN sources USING (source_id) GROUP BY product_id
)
SELECT product_id, CASE WHEN labelled THEN 'verified' WHEN conflict THEN 'conflict' WHEN verified OR stated THEN 'unverified' ELSE 'missing' END AS trust,
  CASE WHEN labelled THEN 'label' WHEN verified THEN 'reviewed' WHEN stated THEN 'source' END AS authority FROM seen""")
def trust_status_case(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _records(spark, folder).join(_sources(spark, folder).select("source_id", "nutrition_authority"), "source_id", "left")
    verified = F.col("status") == "verified"
    seen = ranked.groupBy("product_id").agg(
        F.bool_or(verified & (F.coalesce("nutrition_authority", F.lit(0)) >= 90)).alias("labelled"), F.bool_or(verified).alias("verified"),
        F.bool_or(F.col("status") == "conflict").alias("conflict"), F.bool_or(F.col("calories").isNotNull()).alias("stated"),
    )
    trust = nu.first_of([(F.col("labelled"), "verified"), (F.col("conflict"), "conflict"), (F.col("verified") | F.col("stated"), "unverified")], "missing")
    authority = nu.first_of([(F.col("labelled"), "label"), (F.col("verified"), "reviewed"), (F.col("stated"), "source")])
    return seen.select("product_id", trust.alias("trust"), authority.alias("authority"))


# --- metrics and rules -------------------------------------------------------------------------------------------

_CONFLICT = "coalesce(calories > 0 AND protein_grams * 4 > calories, false)"


def _sql_metric(name: str, top: str, below: str, factor: str, missing: str, guarded: bool = True) -> str:
    bad = f"({top}) < 0 OR ({below}) <= 0"
    reason = (f"CASE WHEN {_CONFLICT} THEN 'protein_energy_exceeds_total' " if guarded else "CASE ") + f"WHEN ({top}) IS NULL OR ({below}) IS NULL THEN '{missing}' WHEN {bad} THEN 'invalid_input' END"
    return f"CASE WHEN ({reason}) IS NULL THEN round(({top}) / ({below}) * {factor}, 6) END AS {name}, {reason} AS {name}_reason"


@query(f"""WITH {_RECORDS} SELECT record_id,
  {_sql_metric('protein_per_100_kcal', 'protein_grams', 'calories', '100', 'missing_protein_or_calories')},
  {_sql_metric('protein_energy_percent', 'protein_grams * 4', 'calories', '100', 'missing_protein_or_calories')},
  {_sql_metric('kcal_per_25g_protein', 'calories', 'protein_grams', '25', 'missing_protein_or_calories')},
  CASE WHEN protein_grams IS NOT NULL AND net_quantity_grams > 0 THEN round(net_quantity_grams * protein_grams / 100, 6) END AS protein_in_pack,
  CASE WHEN protein_grams IS NULL OR net_quantity_grams IS NULL OR net_quantity_grams <= 0 THEN 'missing_protein_or_pack_weight' END AS protein_in_pack_reason
FROM records""")
def guarded_metrics(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("double")
    made = nu.nutrition_metrics(F.col("calories"), F.col("protein_grams"), none, none, none, F.col("net_quantity_grams"), F.lit("per_100g"))
    wanted = ("protein_per_100_kcal", "protein_energy_percent", "kcal_per_25g_protein", "protein_in_pack")
    return _records(spark, folder).select("record_id", *_flat(**{k: made[k] for k in wanted}))


@query(f"""WITH {_RECORDS} SELECT record_id, code, severity, field FROM (
  SELECT record_id, unnest([
    CASE WHEN protein_grams > 100 THEN {{'code': 'nutrient_over_100g', 'severity': 'error', 'field': 'protein'}} END,
    CASE WHEN calories <= 0 THEN {{'code': 'non_positive_energy', 'severity': 'error', 'field': 'calories'}} END,
    CASE WHEN calories > 900 THEN {{'code': 'energy_over_physical_maximum', 'severity': 'error', 'field': 'calories'}} END,
    CASE WHEN calories > 0 AND 4 * protein_grams > 1.1::DOUBLE * calories THEN {{'code': 'protein_energy_exceeds_total', 'severity': 'error', 'field': 'protein'}} END,
    CASE WHEN calories > 0 AND 4 * protein_grams > 1.1::DOUBLE * calories THEN {{'code': 'macro_energy_exceeds_total', 'severity': 'error', 'field': 'calories'}} END,
    CASE WHEN protein_grams > 110 THEN {{'code': 'macro_total_impossible', 'severity': 'error', 'field': 'protein'}} END,
    CASE WHEN serving_size_grams > net_quantity_grams THEN {{'code': 'serving_exceeds_pack', 'severity': 'error', 'field': 'serving_size'}} END
  ], recursive := true) FROM records) WHERE code IS NOT NULL""")
def validation_issues(spark: SparkSession, folder: str) -> DataFrame:
    issues = nu.validation_issues({"calories": F.col("calories"), "protein": F.col("protein_grams")}, F.lit("per_100g"), F.col("net_quantity_grams"), F.col("serving_size_grams"))
    return _records(spark, folder).select("record_id", F.inline(issues))


_EIGHT = ("brand", "item_name", "flavour", "net_quantity_grams", "serving_size_grams", "ingredients_raw", "calories", "protein_grams")


@query(f"""WITH {_RECORDS}, m AS (SELECT record_id, list_filter([{', '.join(f"CASE WHEN {f} IS NULL OR {f}::VARCHAR = '' THEN '{f}' END" for f in _EIGHT)}], lambda x: x IS NOT NULL) AS missing FROM records)
SELECT record_id, CAST(round((8 - len(missing)) * 100.0 / 8) AS INT) AS score, array_to_string(missing, ',') AS missing FROM m""")
def completeness_score(spark: SparkSession, folder: str) -> DataFrame:
    made = nu.completeness({f: F.col(f) for f in _EIGHT})
    return _records(spark, folder).select("record_id", made["score"].alias("score"), F.concat_ws(",", made["missing"]).alias("missing"))


_DENSE = [
    ("protein_at_least_10g_per_100kcal", f"calories > 0 AND NOT {_CONFLICT} AND protein_grams * 100 >= 10 * calories"),
    ("protein_at_least_20_percent_calories", f"calories > 0 AND NOT {_CONFLICT} AND protein_grams * 400 >= 20 * calories"),
    ("protein_at_least_10g_per_serving", "protein_grams * serving_size_grams / 100 >= 10"),
]


@query(f"""WITH {_RECORDS}, r AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _DENSE)}], lambda x: x IS NOT NULL) AS reasons FROM records)
SELECT record_id, array_to_string(reasons, ',') AS reasons,
  CASE WHEN status = 'verified' THEN CASE WHEN len(reasons) > 0 THEN true WHEN calories IS NOT NULL AND protein_grams IS NOT NULL AND NOT {_CONFLICT} THEN false END END AS dense FROM r""")
def density_classifier(spark: SparkSession, folder: str) -> DataFrame:
    reasons = nu.density_reasons(F.col("calories"), F.col("protein_grams"), F.col("serving_size_grams"), F.lit("per_100g"))
    made = _records(spark, folder).withColumn("r", reasons)
    verdict = nu.dense(F.col("calories"), F.col("protein_grams"), F.col("r"), F.col("status") == "verified")
    return made.select("record_id", F.concat_ws(",", "r").alias("reasons"), verdict.alias("dense"))


@query(f"""WITH n AS (SELECT DISTINCT label_id, lower(brand || ' ' || item_name) AS t FROM label_products)
SELECT label_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(t, '{t}') THEN '{t}' END" for t in nu.MARKETED_TERMS)}], lambda x: x IS NOT NULL), ',') AS terms
FROM (SELECT label_id, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS t FROM n)""")
def marketed_terms(spark: SparkSession, folder: str) -> DataFrame:
    name = tx.normalize_text(F.concat_ws(" ", "brand", "item_name"))
    return _labels(spark, folder).select("label_id", F.concat_ws(",", nu.marketed_reasons(name)).alias("terms")).distinct()


# --- windows, aggregates, joins ----------------------------------------------------------------------------------


@query("""SELECT product_id, record_id, content_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingested_at DESC, record_id DESC) AS nth FROM source_records) WHERE nth = 1""")
def current_top1(spark: SparkSession, folder: str) -> DataFrame:
    return rel.top1(table(spark, folder, "source_records"), ["product_id"], [F.col("ingested_at"), F.col("record_id")], ["record_id", "content_hash"])


@query(f"""WITH {_RECORDS}, ranked AS (SELECT product_id, record_id, row_number() OVER (PARTITION BY product_id ORDER BY ingested_at DESC, record_id) AS nth FROM records)
SELECT product_id, string_agg(record_id::VARCHAR, ',' ORDER BY nth) AS newest FROM ranked WHERE nth <= 4 GROUP BY product_id""")
def newest_four(spark: SparkSession, folder: str) -> DataFrame:
    top = rel.top_n(_records(spark, folder), ["product_id"], [F.desc("ingested_at"), F.asc("record_id")], 4)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda s: s["record_id"].cast("string"))
    return top.groupBy("product_id").agg(F.array_join(ordered, ",").alias("newest"))


@query(f"WITH {_BEST} SELECT b.product_id, b.record_id, b.source_id, s.source_kind FROM best b LEFT JOIN sources s USING (source_id)")
def best_source(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder).select("product_id", "record_id", "source_id", "source_kind")


@query(f"""WITH {_RECORDS}, decisions AS (SELECT DISTINCT decision_id, product_id, source_id, decision, field_family FROM evidence_decisions)
SELECT d.decision_id, r.record_id, s.source_kind, d.decision FROM decisions d
JOIN records r ON r.product_id = d.product_id AND r.source_id = d.source_id JOIN sources s ON s.source_id = r.source_id
WHERE d.decision = 'verify' AND d.field_family = 'nutrition' AND r.status = 'verified'""")
def proof_join(spark: SparkSession, folder: str) -> DataFrame:
    decisions = table(spark, folder, "evidence_decisions").where((F.col("decision") == "verify") & (F.col("field_family") == "nutrition"))
    proofs = decisions.select("decision_id", "product_id", "source_id", "decision").distinct().join(_records(spark, folder).where(F.col("status") == "verified"), ["product_id", "source_id"])
    return proofs.join(_sources(spark, folder), "source_id").select("decision_id", "record_id", "source_kind", "decision")


@query("SELECT DISTINCT product_id FROM source_records r WHERE EXISTS (SELECT 1 FROM evidence_decisions d WHERE d.product_id = r.product_id AND d.decision = 'verify')")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    verified = table(spark, folder, "evidence_decisions").where(F.col("decision") == "verify")
    return table(spark, folder, "source_records").select("product_id").distinct().join(verified, "product_id", "left_semi")


@query("SELECT DISTINCT product_id FROM source_records r WHERE NOT EXISTS (SELECT 1 FROM evidence_decisions d WHERE d.product_id = r.product_id)")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_records").select("product_id").distinct().join(table(spark, folder, "evidence_decisions"), "product_id", "left_anti")


@query(f"WITH {_RECORDS} SELECT product_id, min(status) AS status FROM records GROUP BY product_id HAVING count(DISTINCT status) = 1 AND count(*) = count(status)")
def unanimous_key(spark: SparkSession, folder: str) -> DataFrame:
    return rel.unanimous(_records(spark, folder), ["product_id"], "status")


_STRICT = """SELECT DISTINCT product_id FROM records r
WHERE (EXISTS (SELECT 1 FROM records v WHERE v.product_id = r.product_id AND v.status = 'verified') AND NOT EXISTS (SELECT 1 FROM evidence_decisions d WHERE d.product_id = r.product_id AND d.decision = 'reject'))
   OR (NOT EXISTS (SELECT 1 FROM records v WHERE v.product_id = r.product_id AND v.status = 'verified') AND EXISTS (SELECT 1 FROM agreed u WHERE u.product_id = r.product_id))"""
_AGREED = "agreed AS (SELECT product_id FROM evidence_decisions GROUP BY product_id HAVING min(decision) = 'verify' AND max(decision) = 'verify')"


@query(f"WITH {_RECORDS}, {_AGREED} {_STRICT}")
def exists_in_or(spark: SparkSession, folder: str) -> DataFrame:
    """Existence tests inside OR, as flags aggregated per product before the join: no existence join, no fan-out."""
    records = _records(spark, folder).groupBy("product_id").agg(F.bool_or(F.col("status") == "verified").alias("verified"))
    told = table(spark, folder, "evidence_decisions").groupBy("product_id").agg(F.bool_or(F.col("decision") == "reject").alias("rejected"), F.bool_and(F.col("decision") == "verify").alias("agreed"))
    no = F.lit(False)
    both = records.join(told, "product_id", "left")
    verified = F.coalesce("verified", no)
    return both.where((verified & ~F.coalesce("rejected", no)) | (~verified & F.coalesce("agreed", no))).select("product_id")


@query(f"""WITH {_RECORDS}, {_AGREED}, strict AS ({_STRICT}), {_TOP}
SELECT b.product_id, b.record_id FROM best b SEMI JOIN strict USING (product_id) WHERE b.calories IS NOT NULL AND b.protein_grams IS NOT NULL""")
def strict_trust(spark: SparkSession, folder: str) -> DataFrame:
    best = _best(spark, folder).where(F.col("calories").isNotNull() & F.col("protein_grams").isNotNull())
    return best.join(exists_in_or(spark, folder), "product_id", "left_semi").select("product_id", "record_id")


@query("""WITH ledger AS (SELECT run_id, lag(run_id) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS supersedes, source_id FROM ingestion_runs)
SELECT run_id, source_id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger x WHERE x.supersedes = l.run_id)""")
def supersession_heads(spark: SparkSession, folder: str) -> DataFrame:
    before = F.lag("run_id").over(Window.partitionBy("source_id").orderBy("started_at", "run_id"))
    ledger = table(spark, folder, "ingestion_runs").select("run_id", "source_id", before.alias("supersedes"))
    return rel.supersession_heads(ledger, "run_id", "supersedes").select("run_id", "source_id")


@query("""SELECT s.source_id, r.run_id, r.status FROM sources s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS nth FROM ingestion_runs) r ON r.source_id = s.source_id AND r.nth = 1""")
def latest_run_per_source(spark: SparkSession, folder: str) -> DataFrame:
    latest = rel.top1(table(spark, folder, "ingestion_runs"), ["source_id"], [F.col("started_at"), F.col("run_id")], ["run_id", "status"])
    return table(spark, folder, "sources").select("source_id").join(latest, "source_id", "left")


@query("""WITH n AS (SELECT DISTINCT label_id AS id, trim(regexp_replace(lower(strip_accents(brand)), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(replace(lower(strip_accents(item_name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS n FROM label_products),
m AS (SELECT DISTINCT -listing_id AS id, trim(regexp_replace(lower(strip_accents(regexp_replace(brand, '[™®©]', '', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(replace(lower(strip_accents(regexp_replace(item_name, '[™®©]', '', 'g'))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS n FROM listings)
SELECT x.id AS left_id, y.id AS right_id, CASE WHEN x.n = y.n THEN 92 ELSE 78 END AS score
FROM n x JOIN m y ON x.b = y.b AND (x.n = y.n OR starts_with(x.n, y.n || ' ') OR starts_with(y.n, x.n || ' ')) WHERE x.b <> '' AND x.n <> '' AND y.n <> ''""")
def prefix_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Labels against listings of the same brand; listings have negative ids here."""
    def named(name: str, key: Column) -> DataFrame:
        return table(spark, folder, name).select(key.alias("id"), tx.normalize_text(F.col("brand")).alias("b"), tx.normalize_text(F.col("item_name")).alias("n")).distinct()

    return rel.prefix_candidates(named("label_products", F.col("label_id")), named("listings", -F.col("listing_id")), "b", "n", "id", "id")


@query(f"""WITH {_RECORDS} SELECT count(*) AS records, count(DISTINCT product_id) AS products, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'conflict') AS conflict,
  count(*) FILTER (calories IS NOT NULL AND protein_grams IS NOT NULL) AS usable, count(*) FILTER (calories > 0 AND protein_grams * 4 <= calories) AS consistent, max(ingested_at) AS as_of FROM records""")
def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).agg(
        F.count("*").alias("records"), F.countDistinct("product_id").alias("products"), F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "conflict").alias("conflict"), F.count_if(F.col("calories").isNotNull() & F.col("protein_grams").isNotNull()).alias("usable"),
        F.count_if((F.col("calories") > 0) & (F.col("protein_grams") * 4 <= F.col("calories"))).alias("consistent"), F.max("ingested_at").alias("as_of"),
    )


@query(f"WITH {_RECORDS} SELECT source_id, status, count(*) AS n FROM records GROUP BY ALL")
def grouped_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).groupBy("source_id", "status").agg(F.count("*").alias("n"))


@query("SELECT seller, count(DISTINCT listing_id) AS listings, count(DISTINCT category) AS categories FROM listings GROUP BY seller")
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").groupBy("seller").agg(F.countDistinct("listing_id").alias("listings"), F.countDistinct("category").alias("categories"))


@query("""WITH codes AS (
  SELECT product_id, 'status:' || lower(trim(nutrition_status)) AS code FROM source_records UNION ALL SELECT product_id, 'decision:' || decision FROM evidence_decisions)
SELECT product_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM codes GROUP BY product_id""")
def reason_codes(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "source_records").select("product_id", F.concat(F.lit("status:"), F.lower(F.trim("nutrition_status"))).alias("code"))
    b = table(spark, folder, "evidence_decisions").select("product_id", F.concat(F.lit("decision:"), "decision").alias("code"))
    return a.unionByName(b).groupBy("product_id").agg(F.array_join(sorted_unique(F.collect_set("code")), ",").alias("codes"))


@query("""SELECT source_id, field_family, count(*) AS total, count(*) FILTER (decision = 'verify') AS verify, count(*) FILTER (decision = 'reject') AS reject, count(*) FILTER (decision = 'redundant') AS redundant
FROM (SELECT DISTINCT decision_id, source_id, field_family, decision FROM evidence_decisions) GROUP BY ALL""")
def outcome_summary(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "evidence_decisions").select("decision_id", "source_id", "field_family", "decision").distinct()
    return ledgers.outcome_summary(once, ["source_id", "field_family"], "decision", ["verify", "reject", "redundant"])


@query("""SELECT source_id, total, failed, failed / total AS failure_rate, failed <= 10 AND failed / total <= 0.0025 AS accepted FROM (
  SELECT source_id, count(*) AS total, count(*) FILTER (NOT source_complete) AS failed FROM ingestion_runs GROUP BY source_id)""")
def residual_bounds(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "ingestion_runs").groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(~F.col("source_complete")).alias("failed"))
    return ledgers.residual_bounds(counts, "total", "failed")


# --- sets, partitions, duplicates ----------------------------------------------------------------------------------


@query("""WITH l AS (SELECT DISTINCT product_id FROM source_records), r AS (SELECT DISTINCT product_id FROM evidence_decisions),
a AS (SELECT count(*) AS n FROM (FROM l EXCEPT FROM r)), b AS (SELECT count(*) AS n FROM (FROM r EXCEPT FROM l))
SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys, a.n AS only_left, b.n AS only_right, a.n = 0 AND b.n = 0 AS equal FROM a, b""")
def set_equality(spark: SparkSession, folder: str) -> DataFrame:
    return rel.set_difference_counts(table(spark, folder, "source_records"), table(spark, folder, "evidence_decisions"), ["product_id"])


@query("SELECT brand AS name FROM label_products UNION SELECT brand_name FROM brand_sources")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "label_products").select(F.col("brand").alias("name")).union(table(spark, folder, "brand_sources").select("brand_name")).distinct()


@query("SELECT DISTINCT label_id, nutrient_code, lower(unit) AS unit FROM nutrient_values")
def set_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nutrient_values").select("label_id", "nutrient_code", F.lower("unit").alias("unit")).distinct()


@query("""WITH a AS (SELECT label_id, count(*) AS n FROM label_products GROUP BY 1), b AS (SELECT label_id, count(*) AS n FROM (SELECT DISTINCT label_id FROM nutrient_values) GROUP BY 1)
SELECT coalesce(a.label_id, b.label_id) AS label_id, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'unexpected' ELSE 'duplicate' END AS violation
FROM a FULL JOIN b ON a.label_id = b.label_id WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1 OR b.n > 1""")
def partition_check(spark: SparkSession, folder: str) -> DataFrame:
    return rel.partition_check(table(spark, folder, "label_products"), table(spark, folder, "nutrient_values").select("label_id").distinct(), "label_id")


@query("SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents")
def dedupe_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    hashed = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rel.keep_first(hashed, ["digest"], "doc_id").select("doc_id", "kept")


@query("""SELECT decision_id, count(*) AS "rows", CASE WHEN count(DISTINCT candidate_hash || decision) = 1 THEN 'same' ELSE 'conflict' END AS state FROM evidence_decisions GROUP BY decision_id""")
def decision_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return ledgers.dedupe_ledger(table(spark, folder, "evidence_decisions").withColumn("content", F.concat("candidate_hash", "decision")), "decision_id", "content")


@query("SELECT product_id, field_family, count(DISTINCT decision_id) AS ids FROM evidence_decisions GROUP BY ALL HAVING count(DISTINCT decision_id) > 1")
def ambiguous_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return ledgers.ambiguous_keys(table(spark, folder, "evidence_decisions"), ["product_id", "field_family"], "decision_id")


@query(f"""WITH {_RECORDS} SELECT record_id FROM records r WHERE NOT EXISTS (SELECT 1 FROM evidence_decisions d WHERE d.product_id = r.product_id AND d.source_id = r.source_id)""")
def unreviewed(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).join(table(spark, folder, "evidence_decisions"), ["product_id", "source_id"], "left_anti").select("record_id")


@query(f"""WITH {_RECORDS}, cur AS (SELECT product_id, source_id, arg_max(content_hash, (ingested_at, record_id)) AS h, arg_max(status, (ingested_at, record_id)) AS st FROM records GROUP BY ALL),
d AS (SELECT DISTINCT decision_id, product_id, source_id, source_content_hash, CASE WHEN decision = 'verify' THEN 'verified' END AS wants FROM evidence_decisions)
SELECT decision_id, CASE WHEN cur.product_id IS NULL THEN 'candidate_missing' WHEN d.source_content_hash IS DISTINCT FROM cur.h THEN 'source_revision_drift' WHEN d.wants IS DISTINCT FROM cur.st THEN 'status_drift' ELSE 'exact' END AS classification
FROM d LEFT JOIN cur ON cur.product_id = d.product_id AND cur.source_id = d.source_id""")
def drift_classes(spark: SparkSession, folder: str) -> DataFrame:
    current = rel.top1(_records(spark, folder), ["product_id", "source_id"], [F.col("ingested_at"), F.col("record_id")], ["content_hash", "status"])
    decisions = table(spark, folder, "evidence_decisions").select("decision_id", "product_id", "source_id", "source_content_hash", F.when(F.col("decision") == "verify", "verified").alias("wants")).distinct()
    pairs = {"source_revision_drift": ("source_content_hash", "content_hash"), "status_drift": ("wants", "status")}
    return ledgers.drift(decisions, current, ["product_id", "source_id"], pairs).select("decision_id", "classification")


@query(f"""WITH {_RECORDS} SELECT product_id, count(*) AS "rows", greatest(coalesce((max(calories) - min(calories)) / greatest(max(calories), 1), 0), coalesce((max(protein_grams) - min(protein_grams)) / greatest(max(protein_grams), 1), 0)) > 0.15 AS conflict
FROM records GROUP BY product_id""")
def cross_record_conflict(spark: SparkSession, folder: str) -> DataFrame:
    return ledgers.cross_conflict(_records(spark, folder), ["product_id"], ["calories", "protein_grams"], 0.15)


@query(f"""WITH {_RECORDS}, a AS (SELECT product_id, arg_min(calories, record_id) AS kcal, arg_min(protein_grams, record_id) AS p FROM records WHERE source_id = 'open_catalogue' GROUP BY 1),
b AS (SELECT product_id, arg_min(calories, record_id) AS kcal, arg_min(protein_grams, record_id) AS p FROM records WHERE source_id = 'open_catalogue_api' GROUP BY 1)
SELECT product_id, array_to_string(list_filter([CASE WHEN a.kcal IS NULL OR b.kcal IS NULL THEN 'calories_unread' WHEN abs(a.kcal - b.kcal) > 0.01::DOUBLE THEN 'calories_differ' END,
  CASE WHEN a.p IS NULL OR b.p IS NULL THEN 'protein_unread' WHEN abs(a.p - b.p) > 0.01::DOUBLE THEN 'protein_differ' END], lambda x: x IS NOT NULL), ',') AS reasons FROM a JOIN b USING (product_id)""")
def reader_agreement(spark: SparkSession, folder: str) -> DataFrame:
    def reading(source: str, tag: str) -> DataFrame:
        return (
            _records(spark, folder).where(F.col("source_id") == source).groupBy("product_id")
            .agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("record_id", F.col(c).alias("v"))))["v"].alias(f"{n}_{tag}") for c, n in (("calories", "calories"), ("protein_grams", "protein"))])
        )

    def reasons(n: str) -> Column:
        a, b = F.col(f"{n}_a"), F.col(f"{n}_b")
        return F.when(a.isNull() | b.isNull(), f"{n}_unread").when(~nu.within(a, b, 0.01), f"{n}_differ")

    both = reading("open_catalogue", "a").join(reading("open_catalogue_api", "b"), "product_id")
    return both.select("product_id", F.array_join(F.filter(F.array(reasons("calories"), reasons("protein")), lambda r: r.isNotNull()), ",").alias("reasons"))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(l.k, o.k) AS orderkey, coalesce(l.n, 0) AS left_rows, coalesce(o.n, 0) AS right_rows FROM l FULL JOIN o ON l.k = o.k WHERE coalesce(l.n, 0) <> coalesce(o.n, 0)""")
def artifact_checks(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return ledgers.multiset_difference(lines, table(spark, folder, "orders").select(F.col("o_orderkey").alias("orderkey")), "orderkey")


# --- entities, upserts, diff ---------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(replace(lower(strip_accents(regexp_replace(regexp_replace(coalesce({0}, ''), '[™®©]', '', 'g'), '[βΒ]', ' beta ', 'g'))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_GRAMS = "regexp_replace(net_quantity_grams::VARCHAR, '\\.0$', '')"
_KEY = f"CASE WHEN {_NORM.format('brand')} <> '' AND {_NORM.format('item_name')} <> '' AND {_NORM.format('flavour')} <> '' AND net_quantity_grams > 0 THEN {_NORM.format('brand')} || '|' || {_NORM.format('item_name')} || '|' || {_NORM.format('flavour')} || '|' || {_GRAMS} END"
_CLEAN = "regexp_replace(gtin, '[\\s\\-]', '', 'g')"
_DIGIT = " + ".join(f"(coalesce(try_cast(substr(d, {i + 1}, 1) AS INT), 0) * {3 if i % 2 == 0 else 1})" for i in range(13))
_GTIN = f"""CASE WHEN regexp_full_match({_CLEAN}, '[0-9]{{8}}|[0-9]{{12,14}}') AND (SELECT (10 - ({_DIGIT}) % 10) % 10 = try_cast(substr(d, 14, 1) AS INT) FROM (SELECT lpad({_CLEAN}, 14, '0') AS d)) THEN lpad({_CLEAN}, 14, '0') END"""


@query(f"SELECT DISTINCT listing_id, {_GTIN} AS gtin14 FROM listings")
def gtin_check(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select("listing_id", tx.gtin14(F.col("gtin")).alias("gtin14")).distinct()


@query(f"""WITH i AS (SELECT DISTINCT listing_id AS id, {_GTIN} AS g, {_KEY} AS k FROM listings),
c AS (SELECT DISTINCT label_id AS id, {_GTIN} AS g, {_KEY} AS k FROM label_products),
gs AS (SELECT g, min(id) AS m, count(*) AS n FROM c WHERE g IS NOT NULL GROUP BY g), ks AS (SELECT k, min(id) AS m, count(*) AS n FROM c WHERE k IS NOT NULL GROUP BY k)
SELECT i.id, CASE WHEN gs.n = 1 THEN gs.m WHEN gs.n IS NULL AND ks.n = 1 THEN ks.m END AS match_id,
  CASE WHEN gs.n = 1 THEN 'exact_gtin' WHEN gs.n > 1 THEN 'duplicate_canonical_gtin' WHEN i.k IS NULL THEN 'insufficient_exact_identity' WHEN ks.n = 1 THEN 'exact_composite' WHEN ks.n > 1 THEN 'ambiguous_exact_composite' ELSE 'no_exact_match' END AS outcome
FROM i LEFT JOIN gs ON gs.g = i.g LEFT JOIN ks ON ks.k = i.k""")
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Of the columns as they are: signs dropped and '&' spelled out by the operator itself."""
    columns = ("gtin", "brand", "item_name", "flavour", "net_quantity_grams")
    incoming = keyed(table(spark, folder, "listings"), "listing_id", *columns).distinct()
    return resolve_entities(incoming, keyed(table(spark, folder, "label_products"), "label_id", *columns).distinct())


@query(f"""WITH {_RECORDS} SELECT product_id, record_id, ingredients_raw FROM (SELECT r.*, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(ingredient_authority, 0) DESC, ingested_at DESC, record_id DESC) AS nth
  FROM (SELECT * FROM records WHERE ingredients_raw IS NOT NULL) r LEFT JOIN sources s USING (source_id)) WHERE nth = 1""")
def upsert_precedence_ingredient(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder).where(F.col("ingredients_raw").isNotNull()).join(_sources(spark, folder).select("source_id", "ingredient_authority"), "source_id", "left")
    ranked = rows.select("product_id", F.coalesce("ingredient_authority", F.lit(0)).alias("authority"), "ingested_at", "record_id", "ingredients_raw")
    order = ["authority", "ingested_at", "record_id"]
    records = table(spark, folder, "source_records")
    first, last = records.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    middle = None if first is None else str(first + (last - first) / 2)
    late = F.coalesce(F.col("ingested_at") > F.lit(middle).cast(records.schema["ingested_at"].dataType), F.lit(True))
    held = upserts.upsert_total_order(ranked.limit(0), ranked.where(~late), ["product_id"], order)
    merged = upserts.upsert_total_order(held, ranked.where(late), ["product_id"], order)
    return merged.select("product_id", "record_id", "ingredients_raw")


@query(f"""WITH RECURSIVE {_RECORDS}, rows_ AS (
  SELECT product_id, record_id, ingested_at AS seen, (calories IS NOT NULL)::INT + (protein_grams IS NOT NULL)::INT + (serving_size_grams IS NOT NULL)::INT AS filled, coalesce(nutrition_authority, 0) AS auth,
    row_number() OVER (PARTITION BY product_id ORDER BY record_id) AS nth FROM records LEFT JOIN sources USING (source_id)
), fold AS (
  SELECT product_id, nth, record_id, seen, filled, auth FROM rows_ WHERE nth = 1
  UNION ALL
  SELECT r.product_id, r.nth, CASE WHEN r.auth > f.auth OR (r.auth = f.auth AND r.seen > f.seen AND r.filled >= f.filled) THEN r.record_id ELSE f.record_id END,
    CASE WHEN r.auth > f.auth OR (r.auth = f.auth AND r.seen > f.seen AND r.filled >= f.filled) THEN r.seen ELSE f.seen END,
    CASE WHEN r.auth > f.auth OR (r.auth = f.auth AND r.seen > f.seen AND r.filled >= f.filled) THEN r.filled ELSE f.filled END, greatest(r.auth, f.auth)
  FROM fold f JOIN rows_ r ON r.product_id = f.product_id AND r.nth = f.nth + 1
) SELECT product_id, record_id FROM fold QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY nth DESC) = 1""")
def upsert_precedence_nutrition(spark: SparkSession, folder: str) -> DataFrame:
    has = lambda c: F.col(c).isNotNull().cast("int")
    rows = _records(spark, folder).join(_sources(spark, folder).select("source_id", "nutrition_authority"), "source_id", "left").select(
        "product_id", "record_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), (has("calories") + has("protein_grams") + has("serving_size_grams")).alias("filled"), F.coalesce("nutrition_authority", F.lit(0)).alias("auth"),
    )
    return upserts.fold_by_precedence(rows, "product_id", ["record_id"], "auth", "at", "filled", ["record_id"])


@query("""WITH old AS (SELECT product_id, arg_min(brand, record_id) AS brand, min(net_quantity_grams) AS grams FROM source_records GROUP BY 1),
new AS (SELECT product_id, arg_max(brand, record_id) AS brand, max(net_quantity_grams) AS grams FROM source_records WHERE lower(trim(nutrition_status)) = 'verified' GROUP BY 1)
SELECT product_id, coalesce(new.brand, old.brand) AS brand, CASE WHEN new.product_id IS NULL THEN old.grams ELSE greatest(old.grams, new.grams) END AS grams FROM old LEFT JOIN new USING (product_id)""")
def merge_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_records")
    branded = F.when(F.col("brand").isNotNull(), F.struct("record_id", "brand"))
    old = rows.groupBy("product_id").agg(F.min(branded)["brand"].alias("brand"), F.min("net_quantity_grams").alias("grams"))
    new = rows.where(F.lower(F.trim("nutrition_status")) == "verified").groupBy("product_id").agg(F.max(branded)["brand"].alias("brand"), F.max("net_quantity_grams").alias("grams"))
    return upserts.merge_columns(old, new, "product_id", {"brand": "prefer", "grams": "greatest"})


@query("""SELECT field_name, product_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field_name ORDER BY authority DESC, ingested_at DESC, record_id) AS nth FROM (
  SELECT DISTINCT product_id, record_id, ingested_at, coalesce(identity_authority, 0) AS authority, unnest(['brand', 'item_name', 'flavour']) AS field_name, unnest([brand, item_name, flavour]) AS v
  FROM source_records r LEFT JOIN sources s ON s.source_id = lower(trim(r.source_id))) WHERE v IS NOT NULL) WHERE nth = 1""")
def observation_select(spark: SparkSession, folder: str) -> DataFrame:
    each = _records(spark, folder).join(_sources(spark, folder).select("source_id", "identity_authority"), "source_id", "left").select(
        "product_id", "record_id", "ingested_at", F.coalesce("identity_authority", F.lit(0)).alias("authority"), F.explode(F.create_map(*[x for f in ("brand", "item_name", "flavour") for x in (F.lit(f), F.col(f))])).alias("field_name", "v"),
    )
    return rel.top1(each.where(F.col("v").isNotNull()), ["product_id", "field_name"], [F.col("authority"), F.col("ingested_at"), -F.col("record_id")], ["record_id"])


@query(f"""WITH {_RECORDS} SELECT product_id, array_to_string(list_filter([CASE WHEN a.brand IS DISTINCT FROM b.brand THEN 'brand' END, CASE WHEN a.item_name IS DISTINCT FROM b.item_name THEN 'item_name' END,
  CASE WHEN a.calories IS DISTINCT FROM b.calories THEN 'calories' END], lambda x: x IS NOT NULL), ',') AS changed
FROM (SELECT * FROM records WHERE record_id IN (SELECT min(record_id) FROM records GROUP BY product_id)) a JOIN (SELECT * FROM records WHERE record_id IN (SELECT max(record_id) FROM records GROUP BY product_id)) b USING (product_id)""")
def field_changes(spark: SparkSession, folder: str) -> DataFrame:
    row = F.struct("record_id", "brand", "item_name", "calories")
    ends = _records(spark, folder).groupBy("product_id").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    fields = ("brand", "item_name", "calories")
    return ends.select("product_id", F.array_join(changed_fields({f: F.col(f"a.{f}") for f in fields}, {f: F.col(f"b.{f}") for f in fields}), ",").alias("changed"))


@query("""SELECT l.label_id, CASE WHEN n.label_id IS NULL THEN 'not_found' WHEN n.usable = 0 THEN 'rejected' WHEN n.usable < n.total THEN 'enriched' ELSE 'unchanged' END AS outcome
FROM (SELECT DISTINCT label_id FROM label_products) l LEFT JOIN (SELECT label_id, count(DISTINCT value_id) AS total, count(DISTINCT value_id) FILTER (basis IS NOT NULL AND basis NOT IN ('', 'unknown')) AS usable FROM nutrient_values GROUP BY 1) n USING (label_id)""")
def enrichment_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    stated = F.col("basis").isNotNull() & ~F.col("basis").isin("", "unknown")
    have = table(spark, folder, "nutrient_values").groupBy("label_id").agg(F.countDistinct("value_id").alias("total"), F.countDistinct(F.when(stated, F.col("value_id"))).alias("usable"))
    both = table(spark, folder, "label_products").select("label_id").distinct().join(have, "label_id", "left")
    rules = [(F.col("total").isNull(), "not_found"), (F.col("usable") == 0, "rejected"), (F.col("usable") < F.col("total"), "enriched")]
    return both.select("label_id", nu.first_of(rules, "unchanged").alias("outcome"))


@query("""WITH v AS (SELECT *, brand IS NULL AND item_name IS NULL AS bad FROM source_records), k AS (SELECT record_id, bad FROM v GROUP BY ALL)
SELECT (SELECT count(*) FROM k WHERE NOT bad) AS staged, (SELECT count(*) FROM (SELECT DISTINCT record_id FROM v WHERE NOT bad AND calories IS NOT NULL)) AS with_calories, (SELECT count(*) FROM v) - (SELECT count(*) FROM k WHERE NOT bad) AS excluded,
  (SELECT count(*) FROM v WHERE NOT bad) - (SELECT count(*) FROM k WHERE NOT bad) AS duplicates, (SELECT count(*) FROM v) AS "read" """)
def staging_manifest(spark: SparkSession, folder: str) -> DataFrame:
    numbered = table(spark, folder, "source_records").withColumn("row_number", F.monotonically_increasing_id())
    issues = {"identity_missing": F.col("brand").isNull() & F.col("item_name").isNull()}
    staged, excluded = stage(numbered, "record_id", ["brand", "item_name", "calories"], issues, "row_number")
    return manifest(staged, excluded, {"calories": "calories"})


@query("""SELECT code, count(*) AS count FROM (SELECT unnest(string_split(basis, ' ')) AS code FROM nutrient_values WHERE basis IS NOT NULL) GROUP BY code""")
def code_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histogram(table(spark, folder, "nutrient_values").select(F.split("basis", " ").alias("codes")), "codes")


# --- JSON, arrays, trees -------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT brand_source_id, unnest(allowed_hosts) AS host FROM brand_sources""")
def json_each(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "brand_sources").select("brand_source_id", F.explode("allowed_hosts").alias("host"))


@query("""UNPIVOT (SELECT record_id, calories, protein_grams, serving_size_grams FROM source_records GROUP BY ALL) ON calories, protein_grams, serving_size_grams INTO NAME code VALUE quantity""")
def unpivot_nutrients(spark: SparkSession, folder: str) -> DataFrame:
    wide = _records(spark, folder).select("record_id", "calories", "protein_grams", "serving_size_grams")
    return wide.unpivot(["record_id"], ["calories", "protein_grams", "serving_size_grams"], "code", "quantity").where(F.col("quantity").isNotNull())


@query("""SELECT DISTINCT brand_source_id, brand_name || CASE WHEN len(coalesce(brand_aliases, [])) > 0 THEN '=' || array_to_string(list_sort(brand_aliases), ',') ELSE '' END AS names FROM brand_sources""")
def compact_maps(spark: SparkSession, folder: str) -> DataFrame:
    fields = F.create_map(F.lit("aliases"), F.array_join(sorted_unique(F.coalesce("brand_aliases", F.array().cast("array<string>"))), ","))
    return table(spark, folder, "brand_sources").select("brand_source_id", F.concat_ws("=", "brand_name", F.element_at(compact(fields), "aliases")).alias("names"))


_TREE = """edges AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
)"""


@query(f"""WITH RECURSIVE {_TREE}, walk AS (
  SELECT id, 0 AS depth, id AS path FROM edges WHERE parent IS NULL UNION ALL SELECT e.id, w.depth + 1, w.path || '>' || e.id FROM walk w JOIN edges e ON e.parent = w.id)
SELECT id, depth, path FROM walk""")
def recursive_tree(spark: SparkSession, folder: str) -> DataFrame:
    def edge(name: str, tag: str, key: str, parent: str | None, of: str) -> DataFrame:
        up = F.lit(None).cast("string") if parent is None else F.concat(F.lit(of), F.col(parent).cast("string"))
        return table(spark, folder, name).select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("node"), up.alias("parent"))

    nodes = edge("region", "r", "r_regionkey", None, "").unionByName(edge("nation", "n", "n_nationkey", "n_regionkey", "r"))
    nodes = nodes.unionByName(edge("supplier", "s", "s_suppkey", "s_nationkey", "n")).unionByName(edge("customer", "c", "c_custkey", "c_nationkey", "n"))
    return trees.tree_paths(nodes, "node", "parent")


@query(None)
def ingredient_tree(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "label_products").select("label_id", "ingredients_raw").distinct()
    return trees.ingredient_nodes(once, "label_id", "ingredients_raw")


# Parts of a text outside brackets: a delimiter cuts where the running depth, never below 0, is 0.
_DEPTHS = """chars AS (SELECT id, d, t, unnest(range(1, length(t) + 1)) AS i FROM texts),
marks AS (SELECT id, d, t, i, substr(t, i, 1) AS c, CASE WHEN substr(t, i, 1) IN ('(', '[') THEN 1 WHEN substr(t, i, 1) IN (')', ']') THEN -1 ELSE 0 END AS step FROM chars),
sums AS (SELECT *, sum(step) OVER (PARTITION BY id, d, t ORDER BY i) AS s FROM marks),
lows AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY id, d, t ORDER BY i)) AS depth FROM sums),
cuts AS (SELECT *, (depth = 0 AND (c IN (',', ';') OR (c = '&' AND NOT regexp_matches(substr(t, 1, i - 1), '-\\s*$'))))::INT AS cut FROM lows),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY id, d, t ORDER BY i) AS nth FROM cuts),
parts AS (SELECT id, d, t, nth, trim(string_agg(c, '' ORDER BY i), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS part FROM numbered WHERE cut = 0 GROUP BY ALL)"""


@query(f"""WITH texts AS (SELECT DISTINCT label_id AS id, 'contains' AS d, contains_raw AS t FROM label_products WHERE contains_raw <> '' UNION SELECT label_id, 'may_contain', traces_raw FROM label_products WHERE traces_raw <> ''),
{_DEPTHS}
SELECT DISTINCT id, trim(regexp_replace(replace(lower(strip_accents(replace(regexp_replace(part, '^[a-zA-Z][a-zA-Z]:', ''), '-', ' '))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name, d AS declaration FROM parts WHERE name <> ''""")
def allergen_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Of every field, also those with brackets or numbered parts."""
    return trees.declared_allergens(_labels(spark, folder), "label_id", "contains_raw", "traces_raw")


@query(f"""WITH texts AS (SELECT DISTINCT label_id AS id, '' AS d, ingredients_raw AS t FROM label_products WHERE trim(ingredients_raw) <> ''), {_DEPTHS}
SELECT id::VARCHAR AS id, (row_number() OVER (PARTITION BY id, t ORDER BY nth) - 1)::INT AS position, part AS raw FROM parts WHERE part <> ''""")
def top_level_parts(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "label_products").select("label_id", "ingredients_raw").distinct()
    return trees.ingredient_nodes(once, "label_id", "ingredients_raw").where("parent_path = ''").select("id", "position", "raw")


# --- text ----------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT listing_id, trim(regexp_replace(replace(lower(strip_accents(regexp_replace(item_name, '[™®©]', '', 'g'))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name FROM listings""")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select("listing_id", tx.normalize_text(F.col("item_name")).alias("name")).distinct()


_QUANTITY = tx.QUANTITY


@query(f"""WITH q AS (SELECT DISTINCT label_id, try_cast(nullif(regexp_extract(lower(trim(net_quantity_text)), '{_QUANTITY}', 1), '') AS DOUBLE) AS v, regexp_extract(lower(trim(net_quantity_text)), '{_QUANTITY}', 2) AS u FROM label_products WHERE net_quantity_text IS NOT NULL)
SELECT label_id, CASE WHEN regexp_full_match(u, 'kilograms?|kgs?') THEN v * 1000 WHEN regexp_full_match(u, 'grams?|g') THEN v END AS grams,
  CASE WHEN regexp_full_match(u, 'millilit(?:er|re)s?|ml') THEN v WHEN regexp_full_match(u, 'centilit(?:er|re)s?|cl') THEN v * 10 WHEN regexp_full_match(u, 'decilit(?:er|re)s?|dl') THEN v * 100 WHEN regexp_full_match(u, 'lit(?:er|re)s?|l') THEN v * 1000 END AS millilitres
FROM q WHERE v > 0""")
def quantity_parse(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "label_products").select("label_id", tx.parse_quantity(F.col("net_quantity_text")).alias("q")).where(F.col("q").isNotNull())
    return said.select("label_id", "q.grams", "q.millilitres").distinct()


def _positive(column: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(lower(trim({column})), '{_QUANTITY}', 1), '') AS DOUBLE) > 0, false)"


@query(f"""SELECT DISTINCT label_id, CASE WHEN lower(net_quantity_unit) IN ('ml', 'cl', 'dl', 'l', 'millilitre', 'milliliter', 'litre', 'liter') THEN 'per_100ml' WHEN lower(net_quantity_unit) IN ('g', 'kg', 'gram', 'grams', 'kilogram', 'kilograms') THEN 'per_100g'
  WHEN {_positive('net_quantity_text')} AND regexp_matches(regexp_extract(lower(trim(net_quantity_text)), '{_QUANTITY}', 2), '^(millilit|centilit|decilit|lit|ml|cl|dl|l$)') THEN 'per_100ml' WHEN {_positive('net_quantity_text')} THEN 'per_100g'
  WHEN {_positive('serving_size_text')} AND regexp_matches(regexp_extract(lower(trim(serving_size_text)), '{_QUANTITY}', 2), '^(millilit|centilit|decilit|lit|ml|cl|dl|l$)') THEN 'per_100ml' ELSE 'per_100g' END AS basis FROM label_products""")
def basis_infer(spark: SparkSession, folder: str) -> DataFrame:
    basis = nu.basis_of(F.lit(None).cast("string"), F.col("net_quantity_unit"), F.col("net_quantity_text"), F.col("serving_size_text"))
    return table(spark, folder, "label_products").select("label_id", basis.alias("basis")).distinct()


@query(f"""WITH n AS (SELECT DISTINCT label_id, trim(regexp_replace(lower(item_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM label_products)
SELECT label_id, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in tx.CATEGORY_RULES)} ELSE 'other' END AS category FROM n""")
def category_rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "label_products").select("label_id", tx.category_of(F.col("item_name")).alias("category")).distinct()


@query(r"""SELECT DISTINCT label_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(ingredients_raw, '(?i)\b(?:ins\s*)?([1-9]\d{2,3}[a-z]?)\b', 1), lambda x: 'INS ' || upper(x)))), ',') AS codes
FROM label_products WHERE ingredients_raw IS NOT NULL""")
def additive_codes(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "label_products").where(F.col("ingredients_raw").isNotNull())
    return said.select("label_id", F.array_join(F.array_sort(tx.additive_codes(F.col("ingredients_raw"))), ",").alias("codes")).distinct()


@query(r"""SELECT DISTINCT label_id, round(list_sum(list_transform(regexp_extract_all(ingredients_raw, '(\d+(?:\.\d+)?)\s*%', 1), lambda x: x::DOUBLE)), 6) AS total FROM label_products WHERE regexp_matches(ingredients_raw, '\d\s*%')""")
def ingredient_percentages(spark: SparkSession, folder: str) -> DataFrame:
    total = F.aggregate(tx.percentages(F.col("ingredients_raw")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, folder, "label_products").where(F.col("ingredients_raw").rlike(r"\d\s*%")).select("label_id", F.round(total, 6).alias("total")).distinct()


@query(r"""SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|li|tr|h[1-6])\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&#(?:0*39|x27);', '''', 'g'), '(?i)&quot;', '"', 'g'), chr(13), '') AS t FROM documents)""")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.html_to_text(F.col("text"))).alias("digest"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS canonical FROM events""")
def timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", times.canonical_time(F.col("ts").cast("timestamp")).alias("canonical"))


@query("""SELECT DISTINCT decision_id, coalesce(regexp_matches(evidence_url, '^https://[^/\\s?#@]+([/?#]\\S*)?$'), false) AS ok, 'prd_' || substr(sha256(product_id), 1, 24) AS stable FROM evidence_decisions""")
def url_and_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence_decisions").select("decision_id", tx.is_https_url(F.col("evidence_url")).alias("ok"), tx.stable_id("prd_", F.col("product_id")).alias("stable")).distinct()


@query("""SELECT decision_id, product_id, decision, decided_at, (SELECT count(DISTINCT decision_id) FROM evidence_decisions) AS total, CAST(ceil((SELECT count(DISTINCT decision_id) FROM evidence_decisions) / 50.0) AS BIGINT) AS pages
FROM (SELECT DISTINCT decision_id, product_id, decision, decided_at FROM evidence_decisions) ORDER BY decided_at DESC, decision_id LIMIT 50 OFFSET 50""")
def paged_ledger(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "evidence_decisions").select("decision_id", "product_id", "decision", "decided_at").distinct()
    return rel.page(once, [F.desc("decided_at"), F.asc("decision_id")], 2, 50)


@query("""SELECT DISTINCT record_id, rule FROM (SELECT record_id, unnest([CASE WHEN NOT coalesce(regexp_full_match(content_hash, '[0-9a-f]{64}'), false) THEN 'content_hash' END,
  CASE WHEN NOT coalesce(lower(trim(nutrition_status)) IN ('missing', 'unverified', 'verified', 'conflict'), false) THEN 'status' END, CASE WHEN brand IS NULL THEN 'brand' END,
  CASE WHEN NOT coalesce(serving_size_grams <= net_quantity_grams, false) THEN 'serving' END]) AS rule FROM source_records) WHERE rule IS NOT NULL""")
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    rules = {
        "content_hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "status": F.col("status").isin("missing", "unverified", "verified", "conflict"),
        "brand": F.col("brand").isNotNull(), "serving": F.col("serving_size_grams") <= F.col("net_quantity_grams"),
    }
    return upserts.violations(_records(spark, folder), rules, "record_id")


@query("""SELECT label_id, observed_at, brand FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY observed_at DESC, brand DESC) AS nth FROM label_products) WHERE nth = 1""")
def current_labels(spark: SparkSession, folder: str) -> DataFrame:
    return latest_by(table(spark, folder, "label_products").select("label_id", "observed_at", "brand"), ["label_id"], ["observed_at"])


@query("""WITH p AS (SELECT DISTINCT decision_id AS id, CASE WHEN starts_with(payload, '"') THEN payload::JSON ->> '$' ELSE payload END AS j FROM evidence_decisions WHERE json_valid(payload)),
e AS (SELECT id, unnest(from_json(coalesce(json_extract(j, '$.candidate.lines'), json_extract(j, '$.lines')), '["JSON"]')) AS l FROM p WHERE json_valid(j)),
l AS (SELECT id, l ->> '$.text' AS t, TRY_CAST(l ->> '$.boundingBox.x' AS DOUBLE) AS x, TRY_CAST(l ->> '$.boundingBox.y' AS DOUBLE) + coalesce(TRY_CAST(l ->> '$.boundingBox.height' AS DOUBLE), 0) / 2 AS m FROM e),
s AS (SELECT *, CASE WHEN m - lag(m) OVER w <= 12 THEN 0 ELSE 1 END AS b FROM l WHERE x IS NOT NULL AND m IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY m, x, t)),
r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY id ORDER BY m, x, t ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS "row" FROM s)
SELECT id, "row", string_agg(t, ' ' ORDER BY x, t) AS text FROM r GROUP BY id, "row" """)
def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    return align_rows(lines_of_payloads(table(spark, folder, "evidence_decisions"), "decision_id", "payload"), 12.0)


@query("""WITH a AS (SELECT product_id, bool_or(calories IS NOT NULL) AS kcal, bool_or(ingredients_raw IS NOT NULL) AS ing FROM source_records WHERE lower(trim(source_id)) = 'open_catalogue' GROUP BY 1),
b AS (SELECT product_id, bool_or(calories IS NOT NULL) AS kcal, bool_or(ingredients_raw IS NOT NULL) AS ing FROM source_records WHERE lower(trim(source_id)) = 'open_catalogue_api' GROUP BY 1),
j AS (SELECT coalesce(a.kcal, false) AS ak, coalesce(b.kcal, false) AS bk, coalesce(a.ing, false) AS ai, coalesce(b.ing, false) AS bi FROM a FULL JOIN b USING (product_id))
SELECT 'calories' AS field, count(*) FILTER (ak) AS before, count(*) FILTER (ak OR bk) AS after, count(*) FILTER (bk AND NOT ak) AS delta FROM j
UNION ALL SELECT 'ingredients', count(*) FILTER (ai), count(*) FILTER (ai OR bi), count(*) FILTER (bi AND NOT ai) FROM j""")
def coverage_deltas(spark: SparkSession, folder: str) -> DataFrame:
    def have(source: str, tag: str) -> DataFrame:
        of = _records(spark, folder).where(F.col("source_id") == source)
        return of.groupBy("product_id").agg(F.bool_or(F.col("calories").isNotNull()).alias(f"calories_{tag}"), F.bool_or(F.col("ingredients_raw").isNotNull()).alias(f"ingredients_{tag}"))

    both = have("open_catalogue", "a").join(have("open_catalogue_api", "b"), "product_id", "full_outer").fillna(False)
    counts = both.agg(*[F.struct(F.lit(f).alias("field"), F.count_if(F.col(f"{f}_a")).alias("before"), F.count_if(F.col(f"{f}_a") | F.col(f"{f}_b")).alias("after"), F.count_if(F.col(f"{f}_b") & ~F.col(f"{f}_a")).alias("delta")).alias(f) for f in ("calories", "ingredients")])
    return counts.select(F.inline(F.array("calories", "ingredients")))


@query("""WITH asked AS (SELECT DISTINCT label_id FROM label_products), done AS (SELECT DISTINCT label_id FROM nutrient_values WHERE basis IS NOT NULL AND basis NOT IN ('', 'unknown'))
SELECT label_id, EXISTS (SELECT 1 FROM done d WHERE d.label_id = a.label_id) AS cached FROM asked a""")
def resume_cache(spark: SparkSession, folder: str) -> DataFrame:
    """What a resumed run takes from its cache, and what it still has to fetch: a semi and an anti join."""
    asked = table(spark, folder, "label_products").select("label_id").distinct()
    done = table(spark, folder, "nutrient_values").where(F.col("basis").isNotNull() & ~F.col("basis").isin("", "unknown")).select("label_id").distinct()
    cached = asked.join(done, "label_id", "left_semi").withColumn("cached", F.lit(True))
    return cached.unionByName(asked.join(done, "label_id", "left_anti").withColumn("cached", F.lit(False)))


@query("""SELECT candidate_hash, count(DISTINCT product_id) AS ids, min(product_id) AS first_id FROM evidence_decisions GROUP BY candidate_hash""")
def asset_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Union of keyed assets: a key with more than one id is a collision."""
    return table(spark, folder, "evidence_decisions").groupBy("candidate_hash").agg(F.countDistinct("product_id").alias("ids"), F.min("product_id").alias("first_id"))


@query(f"""WITH {_RECORDS}, v AS (SELECT product_id, calories, protein_grams, serving_size_grams, min(record_id) AS keeper FROM records WHERE status = 'verified' GROUP BY ALL)
SELECT r.record_id, v.keeper FROM records r JOIN v ON v.product_id = r.product_id AND v.calories IS NOT DISTINCT FROM r.calories AND v.protein_grams IS NOT DISTINCT FROM r.protein_grams AND v.serving_size_grams IS NOT DISTINCT FROM r.serving_size_grams
WHERE r.record_id <> v.keeper""")
def redundant_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records that say exactly what a verified one of the product says, null being a value: null-safe equality on all facts."""
    records = _records(spark, folder)
    facts = ["calories", "protein_grams", "serving_size_grams"]
    held = records.where(F.col("status") == "verified").groupBy("product_id", *facts).agg(F.min("record_id").alias("keeper"))
    same = F.col("r.product_id") == F.col("v.product_id")
    for f in facts:
        same = same & F.col(f"r.{f}").eqNullSafe(F.col(f"v.{f}"))
    return records.alias("r").join(held.alias("v"), same & (F.col("r.record_id") != F.col("v.keeper"))).select("record_id", "keeper")


@query(f"""WITH {_RECORDS}, ok AS (SELECT * FROM records WHERE status = 'verified' AND calories IS NOT NULL AND protein_grams IS NOT NULL),
clash AS (SELECT product_id FROM ok GROUP BY 1 HAVING (max(calories) - min(calories)) / greatest(max(calories), 1) > 0.15 OR (max(protein_grams) - min(protein_grams)) / greatest(max(protein_grams), 1) > 0.15)
SELECT product_id, min(record_id) AS record_id FROM ok WHERE product_id NOT IN (SELECT product_id FROM clash) GROUP BY 1""")
def accepted_batch(spark: SparkSession, folder: str) -> DataFrame:
    """One accepted record per product, none for products whose accepted records disagree."""
    accepted = _records(spark, folder).where((F.col("status") == "verified") & F.col("calories").isNotNull() & F.col("protein_grams").isNotNull())
    clash = ledgers.cross_conflict(accepted, ["product_id"], ["calories", "protein_grams"], 0.15).where("conflict")
    return accepted.join(clash, "product_id", "left_anti").groupBy("product_id").agg(F.min("record_id").alias("record_id"))


@query("""WITH n AS (SELECT DISTINCT label_id AS id, trim(regexp_replace(lower(strip_accents(brand)), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(replace(lower(strip_accents(item_name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS n FROM label_products),
m AS (SELECT DISTINCT -listing_id AS id, trim(regexp_replace(lower(strip_accents(regexp_replace(brand, '[™®©]', '', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(replace(lower(strip_accents(regexp_replace(item_name, '[™®©]', '', 'g'))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS n FROM listings),
c AS (SELECT x.id AS left_id, y.id AS right_id, CASE WHEN x.n = y.n THEN 92 ELSE 78 END AS score FROM n x JOIN m y ON x.b = y.b AND (x.n = y.n OR starts_with(x.n, y.n || ' ') OR starts_with(y.n, x.n || ' ')) WHERE x.b <> '' AND x.n <> '' AND y.n <> '')
SELECT left_id, right_id, score, CAST(nth AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS nth FROM c) WHERE nth <= 8""")
def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """At most eight candidates per label, best first: the report an operator sees."""
    return rel.top_n(prefix_candidates(spark, folder), ["left_id"], [F.desc("score"), F.asc("right_id")], 8)


@query("""WITH changes AS (SELECT run_id, count(DISTINCT trim(source_record_id)) AS listed, count(*) AS delivered FROM snapshot_index GROUP BY run_id)
SELECT r.run_id, r.source_complete, coalesce(c.listed, 0) AS listed, coalesce(c.delivered, 0) - coalesce(c.listed, 0) AS repeated FROM ingestion_runs r LEFT JOIN changes c USING (run_id)""")
def run_accounting(spark: SparkSession, folder: str) -> DataFrame:
    per_run = table(spark, folder, "snapshot_index").groupBy("run_id").agg(F.countDistinct(F.trim("source_record_id")).alias("listed"), F.count("*").alias("delivered"))
    runs = table(spark, folder, "ingestion_runs").select("run_id", "source_complete").join(per_run, "run_id", "left").fillna(0, ["listed", "delivered"])
    return runs.select("run_id", "source_complete", "listed", (F.col("delivered") - F.col("listed")).alias("repeated"))


@query("""WITH d AS (SELECT DISTINCT decision_id, source_id, source_record_key, source_content_hash, product_id, candidate_hash FROM evidence_decisions),
cur AS (SELECT product_id, lower(trim(source_id)) AS source_id, arg_max(content_hash, (ingested_at, record_id)) AS h FROM source_records GROUP BY ALL)
SELECT d.decision_id, 'rea_' || substr(sha256(d.decision_id || '|' || cur.h), 1, 24) AS new_id, cur.h AS content_hash FROM d JOIN cur USING (product_id, source_id) WHERE cur.h <> d.source_content_hash""")
def reattestation_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions whose only drift is the source revision, with the id and revision they would be attested under."""
    rows = table(spark, folder, "source_records").withColumn("source_id", F.lower(F.trim("source_id")))
    current = rel.top1(rows, ["product_id", "source_id"], [F.col("ingested_at"), F.col("record_id")], ["content_hash"])
    decisions = table(spark, folder, "evidence_decisions").select("decision_id", "source_id", "source_content_hash", "product_id").distinct()
    drifted = decisions.join(current, ["product_id", "source_id"]).where(F.col("content_hash") != F.col("source_content_hash"))
    return drifted.select("decision_id", tx.stable_id("rea_", F.concat_ws("|", "decision_id", "content_hash")).alias("new_id"), "content_hash")
