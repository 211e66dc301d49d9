"""Sources and sinks for raw records: delimited and JSON lines, exclusions, manifests, checksums, bundles."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def format_of(path: str, explicit: str | None = None) -> str:
    """'tsv' or 'jsonl' by the flag, else by the extension without '.gz'."""
    if explicit is not None:
        if explicit not in ("tsv", "jsonl"):
            raise ValueError(f"unknown format {explicit}")
        return explicit
    name = path.lower().removesuffix(".gz")
    if name.endswith((".tsv", ".csv", ".txt")):
        return "tsv"
    if name.endswith((".jsonl", ".ndjson", ".json")):
        return "jsonl"
    raise ValueError(f"can't tell the format of {path}")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text without quoting, first line as header, all strings; a missing cell is ''."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").option("nullValue", "\u0000").csv(path).fillna("")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per line; a line that isn't one keeps its text in ``_corrupt``."""
    with_corrupt = StructType([*schema.fields]).add("_corrupt", "string")
    return spark.read.schema(with_corrupt).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def unpivot_per_100(df: DataFrame, id_column: str, suffix: str = "_100g") -> DataFrame:
    """(id, nutrient_code, quantity) of all numeric columns with the suffix, but not those of values and units as typed; negatives are dropped."""
    names = [c for c in df.columns if c.endswith(suffix) and not c.endswith((f"_value{suffix}", f"_unit{suffix}"))]
    if not names:
        return df.select(F.col(id_column), F.lit("").alias("nutrient_code"), F.lit(0.0).alias("quantity")).limit(0)
    plain = df.select(id_column, *[F.col(c).cast("string").try_cast("double").alias(c) for c in names])
    long = plain.unpivot([id_column], names, "nutrient_code", "quantity").where(F.col("quantity") >= 0)
    return long.withColumn("nutrient_code", F.expr(f"left(nutrient_code, length(nutrient_code) - {len(suffix)})"))


def stage(records: DataFrame, key: str, content: list[str], issues: dict[str, object], order: str) -> tuple[DataFrame, DataFrame]:
    """(staged, excluded): valid first occurrences with a content hash, and the others with their reason codes.

    ``issues`` maps a reason code to the condition that excludes a row. Keep-first by ``order``, which must be unique.
    """
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in issues.items()]), lambda r: r.isNotNull())
    hashed = records.withColumn("content_hash", F.sha2(F.to_json(F.struct(*content)), 256)).withColumn("reasons", reasons)
    valid = hashed.where(F.size("reasons") == 0).drop("reasons")
    first = valid.groupBy(key).agg(F.min(order).alias(order))
    staged = valid.join(first, [key, order])
    repeated = valid.join(first, [key, order], "left_anti").select(order, key, F.array(F.lit("duplicate_source_key")).alias("reasons"))
    return staged, hashed.where(F.size("reasons") > 0).select(order, key, "reasons").unionByName(repeated)


def manifest(staged: DataFrame, excluded: DataFrame, required: dict[str, str]) -> DataFrame:
    """One row of run counts and, per required column, how many staged rows have it."""
    have = staged.agg(F.count("*").alias("staged"), *[F.count(c).alias(f"with_{name}") for name, c in required.items()])
    out = excluded.agg(F.struct(F.count("*").alias("excluded"), F.count_if(F.array_contains("reasons", "duplicate_source_key")).alias("duplicates")).alias("out")).scalar()
    return have.withColumn("out", out).select(*have.columns, "out.*").withColumn("read", F.col("staged") + F.col("excluded"))


def continuity_issues(previous: dict, current: dict, most_drop: float) -> list[str]:
    """Counts of the current manifest that fell by more than ``most_drop`` of the previous ones."""
    return sorted(k for k, before in previous.items() if isinstance(before, (int, float)) and before > 0 and (before - current.get(k, 0)) / before > most_drop)


def histogram(df: DataFrame, codes: str) -> DataFrame:
    return df.select(F.explode(codes).alias("code")).groupBy("code").count()


def canonical_line(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def write_bundle(rows: list[dict], folder: Path, family: str) -> str:
    """A content-addressed bundle of decisions (small by nature): sorted canonical lines, a manifest and checksums; its id."""
    lines = [canonical_line(r) for r in sorted(rows, key=lambda r: r["id"])]
    body = "".join(f"{line}\n" for line in lines).encode()
    bundle = "review-" + hashlib.sha256(body).hexdigest()[:20]
    target = folder / bundle
    target.mkdir(parents=True, exist_ok=True)
    about = canonical_line({"bundleId": bundle, "count": len(lines), "family": family, "schemaVersion": 1}).encode() + b"\n"
    (target / "decisions.jsonl").write_bytes(body)
    (target / "manifest.json").write_bytes(about)
    sums = {"decisions.jsonl": body, "manifest.json": about}
    (target / "checksums.sha256").write_text("".join(f"{hashlib.sha256(data).hexdigest()}  {name}\n" for name, data in sorted(sums.items())))
    return bundle


def checksum_issues(folder: Path) -> list[str]:
    """Files of a folder that its checksum ledger lists wrongly, unsafely or not at all."""
    issues, listed = [], set()
    for line in (folder / "checksums.sha256").read_text().splitlines():
        digest, _, name = line.partition("  ")
        path = PurePosixPath(name)
        if not name or path.is_absolute() or ".." in path.parts:
            issues.append(f"unsafe:{name}")
            continue
        listed.add(name)
        file = folder / name
        if not file.is_file():
            issues.append(f"missing:{name}")
        elif hashlib.sha256(file.read_bytes()).hexdigest() != digest:
            issues.append(f"changed:{name}")
    unlisted = {p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file()} - listed - {"checksums.sha256"}
    return sorted([*issues, *(f"unlisted:{n}" for n in unlisted)])
