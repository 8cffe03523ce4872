"""Third-party JSON: package manifests and findings of other scanners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx

# Accepted severity names and the containers a report may use.
SEVERITY_NAMES = {"critical": "critical", "high": "high", "medium": "medium", "moderate": "medium", "low": "low",
                  "info": "info", "informational": "info"}
CONTAINERS = ("findings", "vulnerabilities", "results", "issues")
_DEPENDENCY_GROUPS = ("dependencies", "devDependencies", "peerDependencies")
_MANIFEST_SCHEMA = "main string, " + ", ".join(f"{g} map<string,string>" for g in _DEPENDENCY_GROUPS)


def package_manifests(files: DataFrame) -> DataFrame:
    """One row per dependency of every ``package.json``; broken JSON gives no rows."""
    parsed = (files.where(F.lower(tx.base_name(F.col("path"))) == "package.json")
              .select("repo_id", "path", F.from_json("content", _MANIFEST_SCHEMA).alias("j")))
    empty = F.lit(None).cast("array<struct<key:string,value:string>>")
    entries = F.flatten(F.array_compact(F.array(*[F.map_entries(f"j.{g}") for g in _DEPENDENCY_GROUPS], empty)))
    # a name listed twice keeps its first place and its last version
    return (parsed.select("repo_id", "path", F.col("j.main").alias("main"), F.posexplode(entries).alias("pos", "e"))
            .groupBy("repo_id", "path", "main", F.col("e.key").alias("dep"))
            .agg(F.max_by("e.value", "pos").alias("version"))
            .select("repo_id", "path", "dep", "version", "main"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Whole report files as (run_id, pos, payload)."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"),
                                                         F.col("_metadata.file_path").alias("run_id"))
    return files.withColumn("pos", F.lit(0).cast("bigint"))


def import_findings(runs: DataFrame) -> DataFrame:
    """Map report payloads (run_id, pos, payload) to findings; first of equal (title, file) wins."""
    payload = F.col("payload")
    lists = [F.get_json_object(payload, f"$.{key}") for key in CONTAINERS]
    body = F.when(F.ltrim(payload).startswith("["), payload).otherwise(F.coalesce(*lists))
    items = (runs.select("run_id", "pos", F.posexplode(F.from_json(body, "array<string>")).alias("item_no", "item")))

    def first(*names: str):
        picked = [F.get_json_object("item", f"$.{n}") for n in names]
        return F.coalesce(*[F.when(~p.isin("", "0", "false"), p) for p in picked])

    location = first("location", "file_path", "file")
    nested = F.ltrim(location).startswith("{")
    place = F.when(nested, F.coalesce(F.get_json_object(location, "$.file"), F.get_json_object(location, "$.path"),
                                      F.lit(""))).otherwise(F.coalesce(location, F.lit("")))
    tail = F.when(place.contains(":"), F.regexp_extract(place, r":(\d+)$", 1))
    line = F.coalesce(first("line", "line_number"), F.when(nested, F.get_json_object(location, "$.line")),
                      F.when(tail != "", tail))
    severity = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_NAMES.items() for x in kv]),
                                F.lower(F.coalesce(first("severity", "risk"), F.lit(""))))
    path = tx.drop_dot_slash(F.element_at(F.split(place, ":"), 1))
    mapped = items.select(
        "run_id", "pos", "item_no",
        tx.strip(F.coalesce(first("title", "name", "vulnerability"), F.lit(""))).alias("title"),
        F.coalesce(severity, F.lit("medium")).alias("severity"),
        F.coalesce(first("description", "summary"), F.lit("")).alias("description"),
        F.coalesce(first("remediation", "fix", "recommendation"), F.lit("")).alias("recommendation"),
        F.nullif(path, F.lit("")).alias("file"),
        F.when(line.rlike(r"^\d+$"), line.cast("int")).alias("line"),
        F.coalesce(first("evidence", "proof_of_concept", "poc"), F.lit("")).alias("evidence"),
        first("cwe", "cwe_id").alias("cwe"),
        first("cvss", "cvss_score").alias("cvss"),
        first("validated", "verified", "proof_of_concept").isNotNull().alias("validated"),
    ).where("title <> ''")
    rest = F.struct(*[c for c in mapped.columns if c not in ("run_id", "title", "file")])
    order = F.struct("pos", "item_no")
    # first-wins as an aggregate, so hot titles combine before the shuffle
    return (mapped.groupBy("run_id", "title", "file").agg(F.min_by(rest, order).alias("r"))
            .select("run_id", "title", "file", "r.*"))
