"""Queries of joins, windows, ledgers, JSON and text rules, over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import nutrition as nu
from granary.functions import text as tx
from granary.functions.jsons import append, canonical_json_hash, unknown_keys
from granary.operators import evidence as ev, pages, predictions, relational as rel, trees
from granary.operators.ingest import normalize_source_rows
from granary.operators.label_rows import row_value
from granary.operators.shred import flatten_payloads
from granary.plans.reference_queries import _RECORDS, _labels, _records, _sources
from granary.session import latest_by, shared_folder
from granary.sources.files import read_jsonl, read_tsv
from granary.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None):
    """As in ``reference_queries``, into this module's own tables."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# --- proof chains and current rows ---------------------------------------------------------------------------------

_SNAPSHOTS = "s AS (SELECT DISTINCT run_id, trim(source_record_id) AS k, lower(trim(content_hash)) AS h, brand, item_name FROM snapshot_index)"


@query(f"""WITH r AS (SELECT run_id, source_id, lead(run_id) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS next_run FROM ingestion_runs), {_SNAPSHOTS}
SELECT r.source_id, a.run_id, b.run_id AS next_run, count(*) AS proofs FROM s a JOIN r ON r.run_id = a.run_id JOIN s b ON b.run_id = r.next_run AND b.k = a.k AND b.h = a.h AND b.brand = a.brand AND b.item_name = a.item_name GROUP BY ALL""")
def proof_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Records that the next run of their source delivers unchanged: five equalities, the content hash among them."""
    following = F.lead("run_id").over(Window.partitionBy("source_id").orderBy("started_at", "run_id"))
    runs = table(spark, folder, "ingestion_runs").select("run_id", "source_id", following.alias("next_run"))
    rows = table(spark, folder, "snapshot_index").select("run_id", F.trim("source_record_id").alias("k"), F.lower(F.trim("content_hash")).alias("h"), "brand", "item_name")
    proofs = ev.proof_chain(runs.select("run_id", "next_run").where(F.col("next_run").isNotNull()), rows, "run_id", "next_run", ["k", "h", "brand", "item_name"])
    return proofs.groupBy("run_id", "next_run").agg(F.count("*").alias("proofs")).join(F.broadcast(runs.select("run_id", "source_id")), "run_id").select("source_id", "run_id", "next_run", "proofs")


@query("""SELECT product_id, field_family, decision_id, decision FROM (SELECT d.*, row_number() OVER (PARTITION BY product_id, field_family ORDER BY coalesce(nutrition_authority, 0) DESC, decided_at DESC, decision_id DESC) AS nth
  FROM (SELECT DISTINCT decision_id, product_id, source_id, field_family, decision, decided_at FROM evidence_decisions) d LEFT JOIN sources USING (source_id)) WHERE nth = 1""")
def current_decisions(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "evidence_decisions").select("decision_id", "product_id", "source_id", "field_family", "decision", "decided_at").distinct()
    ranked = once.join(_sources(spark, folder).select("source_id", "nutrition_authority"), "source_id", "left")
    return ev.current_decision(ranked, ["product_id", "field_family"], F.coalesce("nutrition_authority", F.lit(0)), "decided_at", "decision_id", ["decision"])


@query(f"""WITH {_RECORDS} SELECT record_id FROM records r WHERE status = 'verified' AND NOT EXISTS (SELECT 1 FROM records o WHERE o.product_id = r.product_id AND o.status = 'verified'
  AND (o.calories IS DISTINCT FROM r.calories OR o.protein_grams IS DISTINCT FROM r.protein_grams))""")
def uncontradicted_facts(spark: SparkSession, folder: str) -> DataFrame:
    return rel.uncontradicted(_records(spark, folder).where("status = 'verified'"), ["product_id"], ["calories", "protein_grams"]).select("record_id")


@query("""SELECT count(DISTINCT decision_id) AS rejects, max(decided_at) AS latest FROM evidence_decisions WHERE decision = 'reject' HAVING count(*) >= 1""")
def having_without_group(spark: SparkSession, folder: str) -> DataFrame:
    rejects = table(spark, folder, "evidence_decisions").where("decision = 'reject'")
    return rejects.agg(F.countDistinct("decision_id").alias("rejects"), F.max("decided_at").alias("latest")).where("rejects >= 1")


@query(f"""WITH {_RECORDS} SELECT product_id, priority, created, nth AS place FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, created, product_id) AS nth FROM (
  SELECT product_id, count(*) AS priority, min(ingested_at) AS created FROM records WHERE status = 'conflict' GROUP BY product_id)) WHERE nth <= 50""")
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the queue: highest priority, oldest, id; a top-n, then numbered."""
    items = _records(spark, folder).where("status = 'conflict'").groupBy("product_id").agg(F.count("*").alias("priority"), F.min("ingested_at").alias("created"))
    order = [F.desc("priority"), F.asc("created"), F.asc("product_id")]
    first = items.orderBy(*order).limit(50)
    return ev.priority_queue(first.withColumn("all", F.lit(1)), order, ["all"]).drop("all")


@query("SELECT DISTINCT decision_id FROM evidence_decisions WHERE decision = 'verify' ORDER BY decision_id LIMIT 100")
def queue_cut(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evidence_decisions").where("decision = 'verify'").select("decision_id").distinct().orderBy("decision_id").limit(100)


@query("""WITH v AS (SELECT DISTINCT value_id, label_id, nutrient_code FROM nutrient_values), n AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY nutrient_code, value_id) AS nth, count(*) OVER (PARTITION BY label_id) AS c FROM v)
SELECT label_id, value_id, nth AS rank, c > 4 AS truncated FROM n WHERE nth <= 4""")
def bounded_details(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "nutrient_values").select("value_id", "label_id", "nutrient_code").distinct()
    return rel.bounded_details(once, ["label_id"], [F.asc("nutrient_code"), F.asc("value_id")], 4).select("label_id", "value_id", "rank", "truncated")


# --- membership joins ------------------------------------------------------------------------------------------------

@query(f"""WITH {_RECORDS}, l AS (SELECT DISTINCT label_id, item_name AS plain, brand || ' ' || item_name AS long FROM label_products)
SELECT DISTINCT r.record_id, l.label_id FROM records r JOIN l ON r.item_name IN (l.plain, l.long)""")
def either_name_join(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose name is one of two writings of a label's."""
    labels = table(spark, folder, "label_products").select("label_id", F.col("item_name").alias("plain"), F.concat_ws(" ", "brand", "item_name").alias("long")).distinct()
    return rel.membership_join(_records(spark, folder), "item_name", labels, F.array("plain", "long")).select("record_id", "label_id").distinct()


@query("SELECT DISTINCT l.listing_id, b.brand_source_id FROM listings l JOIN brand_sources b ON list_contains(b.brand_aliases, trim(l.brand))")
def alias_membership(spark: SparkSession, folder: str) -> DataFrame:
    listings = table(spark, folder, "listings").select("listing_id", F.trim("brand").alias("named"))
    return rel.membership_join(listings, "named", table(spark, folder, "brand_sources"), F.col("brand_aliases")).select("listing_id", "brand_source_id").distinct()


@query(f"""WITH {_RECORDS} SELECT record_id, EXISTS (SELECT 1 FROM label_products l WHERE l.item_name = r.item_name) OR EXISTS (SELECT 1 FROM listings s WHERE s.item_name = r.item_name) AS matched FROM records r""")
def matched_either_side(spark: SparkSession, folder: str) -> DataFrame:
    """An existence test on two sides in a projection, as one flag per name, counted before the join."""
    names = table(spark, folder, "label_products").select("item_name").unionByName(table(spark, folder, "listings").select("item_name")).distinct().withColumn("there", F.lit(True))
    return _records(spark, folder).join(names, "item_name", "left").select("record_id", F.coalesce("there", F.lit(False)).alias("matched"))


_TABLES = ("listings", "label_products", "nutrient_values", "evidence_decisions", "snapshot_index", "source_records", "sources", "ingestion_runs", "brand_sources", "documents", "eval_items", "mix_targets")


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in _TABLES))
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = [table(spark, folder, t).agg(F.count("*").alias("n")).scalar().alias(t) for t in _TABLES]
    return spark.range(1).select(*counts)


# --- outcomes ----------------------------------------------------------------------------------------------------------

_OUTCOME = "CASE WHEN quantity IS NULL OR trim(quantity) = '' THEN 'rejected' WHEN basis IS NULL OR lower(trim(basis)) = 'unknown' THEN 'failed' ELSE 'candidate' END"


@query(f"""WITH a AS (SELECT DISTINCT label_id FROM label_products WHERE nutrition_status <> 'missing'), t AS (SELECT label_id, min(CASE o WHEN 'candidate' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END) AS best FROM (SELECT label_id, {_OUTCOME} AS o FROM nutrient_values) GROUP BY 1)
SELECT coalesce(a.label_id, t.label_id) AS label_id, CASE WHEN a.label_id IS NOT NULL THEN 'requested' ELSE 'prediction' END AS role, CASE best WHEN 1 THEN 'candidate' WHEN 2 THEN 'rejected' WHEN 3 THEN 'failed' ELSE 'no_prediction' END AS outcome FROM a FULL JOIN t ON a.label_id = t.label_id""")
def role_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    blank, unknown = F.trim(F.coalesce("quantity", F.lit(""))) == "", F.lower(F.trim(F.coalesce("basis", F.lit("unknown")))) == "unknown"
    told = table(spark, folder, "nutrient_values").select("label_id", nu.first_of([(blank, "rejected"), (unknown, "failed")], "candidate").alias("o"))
    asked = table(spark, folder, "label_products").where("nutrition_status <> 'missing'")
    return ev.role_outcomes(asked, told, "label_id", "o", ["candidate", "rejected", "failed"])


@query(f"""WITH {_RECORDS} SELECT product_id, count(t) AS texts, true AS conflict FROM (SELECT product_id, trim(regexp_replace(lower(ingredients_raw), '\\s+', ' ', 'g')) AS t FROM records WHERE status = 'verified') GROUP BY 1 HAVING count(DISTINCT t) > 1""")
def ingredient_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.lower("ingredients_raw"), r"\s+", " "))
    return ev.text_conflicts(_records(spark, folder).where("status = 'verified'"), ["product_id"], text)


@query("""SELECT run_id, array_to_string(list_filter([CASE WHEN NOT coalesce(started_at <= completed_at, false) THEN 'ends_after_start' END, CASE WHEN NOT (source_complete OR status <> 'completed') THEN 'completed_is_whole' END,
  CASE WHEN completed_at IS NULL THEN 'has_end' END], lambda x: x IS NOT NULL), ',') AS broken FROM ingestion_runs WHERE broken <> ''""")
def run_invariants(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"ends_after_start": F.col("started_at") <= F.col("completed_at"), "completed_is_whole": F.col("source_complete") | (F.col("status") != "completed"), "has_end": F.col("completed_at").isNotNull()}
    return ev.broken_invariants(table(spark, folder, "ingestion_runs"), "run_id", rules)


@query(f"""WITH {_RECORDS}, e AS (SELECT product_id, avg(calories) AS calories, avg(protein_grams) AS protein FROM records WHERE source_id = 'open_catalogue' GROUP BY 1), a AS (SELECT product_id, avg(calories) AS calories, avg(protein_grams) AS protein FROM records WHERE source_id = 'label_transcripts' GROUP BY 1)
SELECT product_id, array_to_string(list_filter([CASE WHEN a.product_id IS NULL THEN 'row_missing' END] || CASE WHEN a.product_id IS NULL THEN [] ELSE [{', '.join(f"CASE WHEN e.{f} IS NOT NULL AND a.{f} IS NULL THEN '{f}_missing' WHEN e.{f} IS NULL AND a.{f} IS NOT NULL THEN '{f}_unexpected' WHEN abs(e.{f} - a.{f}) > 0.5 THEN '{f}_differs' END" for f in ('calories', 'protein'))}] END, lambda x: x IS NOT NULL), ',') AS errors
FROM e LEFT JOIN a USING (product_id) WHERE errors <> ''""")
def benchmark_compare(spark: SparkSession, folder: str) -> DataFrame:
    def of(source: str) -> DataFrame:
        return _records(spark, folder).where(F.col("source_id") == source).groupBy("product_id").agg(F.avg("calories").alias("calories"), F.avg("protein_grams").alias("protein"))

    return ev.benchmark_errors(of("open_catalogue"), of("label_transcripts"), ["product_id"], ["calories", "protein"], 0.5)


@query("""WITH c AS (SELECT r.source_id, r.run_id, r.started_at, count(DISTINCT s.source_record_id) AS records FROM ingestion_runs r JOIN snapshot_index s USING (run_id) GROUP BY ALL), l AS (SELECT *, lag(records) OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS before FROM c)
SELECT source_id, run_id, records, before, CASE WHEN before > 0 THEN round((before - records) / before, 9) END AS drop, coalesce((before - records) / before <= 0.02, true) AS accepted FROM l""")
def continuity_guard(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "ingestion_runs").select("run_id", "source_id", "started_at")
    counts = table(spark, folder, "snapshot_index").groupBy("run_id").agg(F.countDistinct("source_record_id").alias("records")).join(F.broadcast(runs), "run_id")
    return rel.continuity(counts, ["source_id"], ["started_at", "run_id"], "records", 0.02).select("source_id", "run_id", "records", "before", F.round("drop", 9).alias("drop"), "accepted")


# --- upserts -----------------------------------------------------------------------------------------------------------


@query("""SELECT record_id, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen, arg_max(content_hash, (ingested_at, content_hash)) AS content_hash FROM source_records GROUP BY 1""")
def record_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The later deliveries upserted into the earlier ones."""
    rows = table(spark, folder, "source_records").select("record_id", "ingested_at", "content_hash")
    late = F.pmod(F.xxhash64("record_id", "ingested_at"), F.lit(2)) == 1
    return ev.first_seen_upsert(rows.where(~late), rows.where(late), "record_id", "ingested_at", ["content_hash"])


@query("""SELECT label_id, nutrient_code, arg_max(value_id, (observed_at, value_id)) AS value_id FROM nutrient_values GROUP BY ALL""")
def natural_key_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nutrient_values").select("label_id", "nutrient_code", "observed_at", "value_id")
    return latest_by(rows, ["label_id", "nutrient_code"], ["observed_at", "value_id"]).select("label_id", "nutrient_code", "value_id")


# --- filters -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_RECORDS}, d AS (SELECT record_id, brand, item_name, source_id, CASE WHEN calories > 0 AND protein_grams IS NOT NULL THEN protein_grams * 100 >= 10 * calories END AS dense FROM records)
SELECT 'true' AS wanted, record_id FROM d WHERE source_id = 'open_catalogue' AND dense UNION ALL SELECT 'unknown', record_id FROM d WHERE source_id = 'open_catalogue' AND dense IS NULL AND (contains(lower(item_name), 'protein') OR contains(lower(item_name), 'whey'))""")
def catalog_filters(spark: SparkSession, folder: str) -> DataFrame:
    dense = F.when((F.col("calories") > 0) & F.col("protein_grams").isNotNull(), F.col("protein_grams") * 100 >= 10 * F.col("calories"))
    rows = _records(spark, folder).withColumn("dense", dense)
    a = rel.filtered(rows, equal={"source_id": "open_catalogue"}, states={"dense": True}).select(F.lit("true").alias("wanted"), "record_id")
    b = rel.filtered(rows, equal={"source_id": "open_catalogue"}, states={"dense": None}, within=[("item_name", ("protein", "whey"))]).select(F.lit("unknown").alias("wanted"), "record_id")
    return a.unionByName(b)


@query(f"""WITH {_RECORDS} SELECT record_id, calories FROM records WHERE calories < 400 OR (calories = 400 AND record_id > 1000) ORDER BY calories DESC, record_id LIMIT 50""")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    """The page after (400 kcal, record 1000): a report page, found without an offset."""
    return rel.page_after(_records(spark, folder).select("record_id", "calories"), "calories", "record_id", 50, (400.0, 1000))


# --- JSON --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_RECORDS}, n AS (SELECT product_id, record_id, status, row_number() OVER (PARTITION BY product_id ORDER BY ingested_at DESC, record_id) AS nth FROM records)
SELECT product_id, coalesce(to_json(list({{'rank': nth, 'record_id': record_id}} ORDER BY nth) FILTER (WHERE nth <= 4 AND status = 'verified'))::VARCHAR, '[]') AS newest FROM n GROUP BY 1""")
def ordered_json(spark: SparkSession, folder: str) -> DataFrame:
    top = rel.top_n(_records(spark, folder), ["product_id"], [F.desc("ingested_at"), F.asc("record_id")], 4)
    told = F.array_sort(F.collect_list(F.when(F.col("status") == "verified", F.struct("rank", "record_id"))))
    return top.groupBy("product_id").agg(F.to_json(told).alias("newest"))


@query("SELECT DISTINCT label_id, to_json(item_name)::VARCHAR AS quoted FROM label_products")
def json_quote(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.to_json(F.array("item_name"))
    return table(spark, folder, "label_products").select("label_id", F.substr(whole, F.lit(2), F.length(whole) - 2).alias("quoted")).distinct()


@query("""SELECT event_id, sha256('{"k":' || (props->>'$.k') || '}') AS hash, json_keys(props) <> ['k'] AS odd FROM events""")
def canonical_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", canonical_json_hash("props").alias("hash"), (F.size(unknown_keys(F.col("props"), ["k"])) > 0).alias("odd"))


@query("SELECT brand_source_id, array_to_string(list_append(allowed_hosts, brand_source_id || '.example'), ',') AS hosts FROM brand_sources")
def json_append(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "brand_sources").select("brand_source_id", F.array_join(append(F.col("allowed_hosts"), F.concat("brand_source_id", F.lit(".example"))), ",").alias("hosts"))


@query(None)
def tree_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The ingredient trees of all payloads, rebuilt from their flat rows."""
    flat = flatten_payloads(table(spark, folder, "evidence_decisions")).where("kind = 'ingredient'")
    last = F.split_part("node_path", F.lit("."), F.lit(-1)).cast("int")
    return trees.rebuild_trees(flat.select("decision_id", F.col("node_path").alias("path"), "parent_path", F.when(F.col("pos") >= 0, F.col("pos")).otherwise(last).alias("position"), F.col("node_text").alias("raw")), "decision_id")


# --- rules of text and numbers -------------------------------------------------------------------------------------------


@query(f"""WITH {_RECORDS}, f AS (SELECT record_id, calories AS k, protein_grams AS p, serving_size_grams AS s, (p + 10) * 4 + 2 * 9 AS floor FROM records)
SELECT record_id, round(CASE WHEN s > 0 THEN p * 100 / s END, 6) AS per_100, round(abs(k - 4 * p) / greatest(abs(k), abs(4 * p), 1), 6) AS difference,
  round(CASE WHEN k / 4.184 < floor * 0.85 AND k <= 1000 AND k BETWEEN floor * 0.85 AND floor * 1.5 THEN k ELSE k / 4.184 END, 6) AS energy, round(k / 4.184, 6) AS from_kj FROM f""")
def number_rules(spark: SparkSession, folder: str) -> DataFrame:
    k, p, s = F.col("calories"), F.col("protein_grams"), F.col("serving_size_grams")
    rules = {"per_100": nu.per_100(p, s), "difference": nu.relative_difference(k, 4 * p), "energy": nu.corrected_energy(k, p, F.lit(10.0), F.lit(2.0)), "from_kj": nu.kcal_from(k, F.lit("kJ"))}
    return _records(spark, folder).select("record_id", *[F.round(v, 6).alias(n) for n, v in rules.items()])


@query(f"""WITH {_RECORDS}, v AS (SELECT record_id, serving_size_grams AS a, CASE WHEN net_quantity_grams <= 1000 THEN net_quantity_grams END AS b, net_quantity_grams AS pack FROM records),
w AS (SELECT *, abs(a - b) / greatest(abs(a), abs(b), 1) <= 0.02 AS agree, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) / greatest(abs(a), abs(b), 1) <= 0.02 THEN a END ELSE coalesce(a, b) END AS g FROM v),
x AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN a IS NOT NULL AND b IS NOT NULL AND NOT agree THEN 'conflict' WHEN NOT ((pack IS NULL OR g <= pack) AND g > 0) THEN 'implausible' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'corroborated' ELSE 'single' END AS state FROM w)
SELECT record_id, CASE WHEN state IN ('single', 'corroborated') THEN g END AS grams, state FROM x""")
def serving_evidence(spark: SparkSession, folder: str) -> DataFrame:
    pack = F.col("net_quantity_grams")
    told = nu.serving_evidence(F.col("serving_size_grams"), F.when(pack <= 1000, pack), pack)
    return _records(spark, folder).select("record_id", told["grams"].alias("grams"), told["state"].alias("state"))


@query(f"""WITH {_RECORDS} SELECT record_id, CASE WHEN protein_grams * 4 > calories AND (status = 'verified' OR flavour IS NOT NULL) THEN 'conflict' WHEN flavour IS NOT NULL THEN 'verified' WHEN status = 'missing' THEN 'unverified' ELSE status END AS status FROM records""")
def status_transition(spark: SparkSession, folder: str) -> DataFrame:
    clash = F.coalesce(F.col("protein_grams") * 4 > F.col("calories"), F.lit(False))
    return _records(spark, folder).select("record_id", nu.next_status(F.col("status"), F.col("flavour").isNotNull(), clash).alias("status"))


_PACK = r"(\d+(?:\.\d+)?)\s*"


@query(rf"""WITH n AS (SELECT DISTINCT listing_id, item_name AS t FROM listings),
g AS (SELECT listing_id, [try_cast(nullif(regexp_extract(t, '(?i)\b{_PACK}(?:kg|kilograms?)\b', 1), '') AS DOUBLE) * 1000,
  try_cast(nullif(regexp_extract(t, '(?i)\b(?:pack(?:\s+of)?|box|jar|pouch|tub|net\s*(?:wt|weight)?|weight)\s*\(?\s*{_PACK}(?:g|grams?)\b', 1), '') AS DOUBLE),
  try_cast(nullif(regexp_extract(t, '(?i)\b{_PACK}(?:g|grams?)\s*(?:$|[|,/(])', 1), '') AS DOUBLE)] AS c FROM n)
SELECT listing_id, list_filter(c, lambda x: x > 0)[1] AS grams FROM g""")
def pack_grams(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "listings").select("listing_id", tx.declared_pack_grams(F.col("item_name"), F.lit(None).cast("string")).alias("grams")).distinct()


@query("""SELECT DISTINCT decision_id, regexp_extract(evidence_url, '/([^/?#]*)$', 1) AS tail, regexp_extract(regexp_extract(evidence_url, '/([^/?#]*)$', 1), '^([^.]+)', 1) AS image_id FROM evidence_decisions WHERE evidence_url LIKE 'https://%' AND NOT contains(evidence_url, ' ')""")
def label_references(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "evidence_decisions").where("evidence_url LIKE 'https://%' AND NOT contains(evidence_url, ' ')").select("decision_id", tx.label_reference(F.col("evidence_url")).alias("r"))
    return told.select("decision_id", "r.tail", "r.image_id").distinct()


@query("""WITH c AS (SELECT brand_source_id, allowed_hosts || list_transform(coalesce(brand_aliases, []), lambda a: replace(lower(a), ' ', '-')) AS codes FROM brand_sources)
SELECT brand_source_id, len(list_filter(codes, lambda c: NOT regexp_full_match(c, '[a-z0-9][a-z0-9._:-]*'))) = 0 AND len(codes) = len(list_distinct(codes)) AS ok FROM c""")
def reason_grammar(spark: SparkSession, folder: str) -> DataFrame:
    aliases = F.transform(F.coalesce("brand_aliases", F.array().cast("array<string>")), lambda a: F.replace(F.lower(a), F.lit(" "), F.lit("-")))
    return table(spark, folder, "brand_sources").select("brand_source_id", tx.reason_codes_ok(F.concat("allowed_hosts", aliases)).alias("ok"))


@query("""SELECT DISTINCT label_id, trim(regexp_replace(replace(lower(regexp_replace('en:' || category, '^[a-z]{2}:', '')), '-', ' '), '[^a-z0-9]+', ' ', 'g')) AS tag FROM label_products""")
def cleaned_tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "label_products").select("label_id", tx.clean_tag(F.concat(F.lit("en:"), "category")).alias("tag")).distinct()


@query("""SELECT DISTINCT decision_id, trim(regexp_replace(lower(rationale), '\\s+', ' ', 'g')) AS text FROM evidence_decisions WHERE regexp_full_match(rationale, '[ -~\\s]*')""")
def comparable_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Of the rationales in ASCII, which compatibility composition leaves as they are."""
    return table(spark, folder, "evidence_decisions").where(F.col("rationale").rlike(r"^[ -~\s]*$")).select("decision_id", tx.comparable_text("rationale").alias("text")).distinct()


@query(r"""SELECT DISTINCT value_id, lower(regexp_extract(t, '(?i)^\s*([a-z][a-z ]*?)\s*[:.|\-]*\s*([0-9]+(?:[.,][0-9]+)?)\s*(kcal|kj|mg|g)\b', 1)) AS name, try_cast(replace(regexp_extract(t, '(?i)^\s*([a-z][a-z ]*?)\s*[:.|\-]*\s*([0-9]+(?:[.,][0-9]+)?)\s*(kcal|kj|mg|g)\b', 2), ',', '.') AS DOUBLE) AS value,
  lower(regexp_extract(t, '(?i)^\s*([a-z][a-z ]*?)\s*[:.|\-]*\s*([0-9]+(?:[.,][0-9]+)?)\s*(kcal|kj|mg|g)\b', 3)) AS unit FROM (SELECT value_id, replace(nutrient_code, '_', ' ') || ' ' || quantity || ' ' || coalesce(unit, '') AS t FROM nutrient_values) WHERE value IS NOT NULL""")
def declared_rows(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.replace("nutrient_code", F.lit("_"), F.lit(" ")), F.lit(" "), "quantity", F.lit(" "), F.coalesce("unit", F.lit("")))
    return table(spark, folder, "nutrient_values").select("value_id", row_value(text).alias("r")).where("r IS NOT NULL").select("value_id", "r.name", "r.value", "r.unit").distinct()


@query("""SELECT DISTINCT label_id, '# ' || item_name || chr(10) || chr(10) || '- brand: ' || brand || chr(10) || '- category: ' || category || coalesce(chr(10) || '- flavour: ' || flavour, '') AS page FROM label_products""")
def markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.concat_ws("\n", F.concat(F.lit("# "), "item_name"), F.lit(""), *[F.concat(F.lit(f"- {c}: "), F.col(c)) for c in ("brand", "category", "flavour")])
    return table(spark, folder, "label_products").select("label_id", lines.alias("page")).distinct()


# --- records, predictions, pages ---------------------------------------------------------------------------------------


@query(f"""WITH {_RECORDS} SELECT record_id::VARCHAR AS source_record_id, CASE WHEN brand IS NULL THEN '' ELSE split_part(trim(brand), ',', 1) END AS brand, nullif(trim(item_name), '') AS name, CASE WHEN net_quantity_grams > 0 THEN net_quantity_grams END AS net_grams,
  calories, protein_grams AS protein, 'per_100g' AS basis, CASE WHEN protein_grams > 100 THEN 'nutrient_over_100g' ELSE '' END AS over FROM records""")
def staged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The records as raw rows of strings, normalised again."""
    text = lambda c: F.col(c).cast("string")
    raw = _records(spark, folder).select(
        text("record_id").alias("code"), F.col("brand").alias("brands"), F.col("item_name").alias("product_name"), text("net_quantity_grams").alias("product_quantity"), F.lit("g").alias("product_quantity_unit"),
        text("calories").alias("energy-kcal_100g"), text("protein_grams").alias("proteins_100g"),
    )
    over = F.array_join(F.filter("issues", lambda i: (i["code"] == "nutrient_over_100g") & (i["field"] == "protein"))["code"], ",")
    return normalize_source_rows(raw).select("source_record_id", "brand", "name", "net_grams", "calories", "protein", "basis", over.alias("over"))


@query(f"""WITH {_RECORDS}, c AS (SELECT product_id, status <> 'missing' AS good, calories, protein_grams, CASE WHEN serving_size_grams > 50 THEN 'per_serving' ELSE 'per_100g' END AS basis FROM records),
k AS (SELECT product_id, count(*) AS predictions, count(*) FILTER (good) AS accepted, coalesce((max(calories) FILTER (good) - min(calories) FILTER (good)) / greatest(max(calories) FILTER (good), 1), 0) AS a,
  coalesce((max(protein_grams) FILTER (good) - min(protein_grams) FILTER (good)) / greatest(max(protein_grams) FILTER (good), 1), 0) AS b, coalesce(min(basis) FILTER (good) <> max(basis) FILTER (good), false) AS mixed FROM c GROUP BY 1)
SELECT product_id, CASE WHEN accepted > 0 THEN 'candidate' ELSE 'rejected' END AS outcome, predictions, greatest(a, b) > 0.15 OR mixed AS conflict FROM k
UNION ALL SELECT 'none', 'no_prediction', 0, false""")
def attempt_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _records(spark, folder)
    reasons = F.when(F.col("status") == "missing", F.array(F.lit("missing"))).otherwise(F.array().cast("array<string>"))
    basis = F.when(F.col("serving_size_grams") > 50, "per_serving").otherwise("per_100g")
    candidates = rows.select("product_id", "calories", F.col("protein_grams").alias("protein"), basis.alias("basis"), reasons.alias("reasons"))
    asked = rows.select("product_id").unionByName(spark.range(1).select(F.lit("none").alias("product_id")))
    return predictions.attempt_outcomes(asked, candidates, "product_id")


@query(f"""WITH {_RECORDS}, p AS (SELECT record_id, calories, protein_grams FROM records WHERE calories IS NOT NULL AND status = 'verified')
SELECT record_id, calories, protein_grams AS protein, CASE WHEN calories > 0 AND protein_grams IS NOT NULL THEN 'per_100g' END AS basis FROM (SELECT record_id, CASE WHEN calories > 0 AND protein_grams IS NOT NULL THEN calories END AS calories, CASE WHEN calories > 0 THEN protein_grams END AS protein_grams FROM p)""")
def prediction_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Verified facts written as a model's map of nutrients, read back as candidates."""
    rows = _records(spark, folder).where("calories IS NOT NULL AND status = 'verified'")
    cell = lambda c, unit: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("string").alias("value"), F.lit(unit).alias("unit"), F.lit(0.9).alias("score")))
    told = F.map_filter(F.create_map(F.lit("energy-kcal_100g"), cell("calories", "kcal"), F.lit("proteins_100g"), cell("protein_grams", "g")), lambda k, v: v.isNotNull())
    made = predictions.nutrition_candidates(rows.select("record_id", F.to_json(told).alias("nutrients")), ["record_id"], "nutrients")
    return made.select("record_id", "calories", "protein", "basis")


@query("SELECT DISTINCT label_id::VARCHAR AS page, 0 AS position, nullif(trim(item_name), '') AS name, nullif(trim(brand), '') AS brand, source_record_id AS sku, gtin FROM label_products")
def page_products(spark: SparkSession, folder: str) -> DataFrame:
    """Each label as a page that describes it in JSON-LD, and the products read from these pages."""
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("item_name").alias("name"), F.struct(F.col("brand").alias("name")).alias("brand"), F.col("source_record_id").alias("sku"), F.col("gtin").alias("gtin13")))
    html = F.concat(F.lit('<p>x</p><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, '), product, F.lit("]}</script>"))
    found = pages.products_of_pages(_labels(spark, folder).select("label_id", html.alias("html")), "label_id", "html")
    return found.select("page", "position", "name", "brand", "sku", "gtin").distinct()


@query(f"""WITH {_RECORDS}, w AS (SELECT record_id, calories, protein_grams, protein_grams / 2 AS sugar FROM records WHERE calories > 0 AND protein_grams IS NOT NULL)
SELECT record_id, unnest(['calories', 'protein', 'sugar']) AS field, unnest([round(calories), round(protein_grams), round(sugar)]) AS value FROM w""")
def page_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Facts printed as a table of a page, with two rows for sugar of which the plain one counts, and read again."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    rows = _records(spark, folder).where("calories > 0 AND protein_grams IS NOT NULL")
    html = F.concat(
        F.lit("<p>Nutrient | Per 100 g</p><p>Energy | "), whole("calories"), F.lit(" kcal</p><p>Added sugars | 1 g</p><p>Protein | "), whole("protein_grams"), F.lit(" g</p><p>Sugar | "), whole(F.col("protein_grams") / 2), F.lit(" g</p>")
    )
    return pages.nutrition_tables(rows.select("record_id", html.alias("html")), "record_id", "html").select(F.col("page").alias("record_id"), "field", "value")


# --- scans -------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, 'tsv' AS format FROM nation UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'jsonl' FROM nation")
def scan_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as tab-separated text and as JSON lines into the shared folder, and scanned again."""
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    place = f"{shared_folder(spark)}/scan_round_trip"
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(f"{place}/tsv")
    rows.write.mode("overwrite").json(f"{place}/jsonl")
    again = read_jsonl(spark, f"{place}/jsonl", rows.schema).where("_corrupt IS NULL").drop("_corrupt")
    return read_tsv(spark, f"{place}/tsv").withColumn("format", F.lit("tsv")).unionByName(again.withColumn("format", F.lit("jsonl")))
