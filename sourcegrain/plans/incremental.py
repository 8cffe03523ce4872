"""Bytes to files, and tables that changes bring up to date: as a second snapshot and as a stream of arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourcegrain.operators import rules as R
from sourcegrain.plans.oracle import SNAPSHOTS, ctes
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import _OUT, _shape, claims_cte
from sourcegrain.session import shared_path, stored
from sourcegrain.sources import corpus, filebytes
from sourcegrain.sources.keyed import FileTable
from sourcegrain.sources.listing import classify
from sourcegrain.streaming import jobs

_FILE = ("repo_id", "path", "language", "kind", "content")
CLAIM = (StructType().add("line_no", "integer").add("rule_order", "integer").add("rule_id", "string").add("family", "string")
         .add("severity", "string").add("title", "string").add("evidence", "string").add("confidence", "double").add("cwe", "string"))


def claim_table(spark: SparkSession, path: str, buckets: int = 64) -> FileTable:
    """A stored table of rule claims by file."""
    return FileTable(spark, path, jobs.scan_arriving, CLAIM, buckets)


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (classify(corpus.code_files(spark, sf_dir)).select(*_FILE)
            .unionByName(corpus.document_files(spark, sf_dir).select(*_FILE)))


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (classify(corpus.next_code_files(spark, sf_dir)).select(*_FILE)
            .unionByName(corpus.next_document_files(spark, sf_dir).select(*_FILE)))


def updated(spark: SparkSession, sf_dir: str) -> FileTable:
    """The claims of the first snapshot, brought up to date with the second."""
    claims = claim_table(spark, shared_path(spark))
    for snapshot in (_first, _second):
        claims.apply(stored(snapshot(spark, sf_dir)), whole=True)  # the derived corpus is made once, as if it were given
    return claims


_CLAIMS = ctes(SNAPSHOTS, claims_cte("new_lines")) + f"SELECT {_OUT} FROM claims"


@query("updated_claims", "A14 A18 I10", _CLAIMS)
def updated_claims(spark, sf_dir):
    """A table of claims that only changed files touch equals a scan of the whole second snapshot."""
    return _shape(updated(spark, sf_dir).entries())


@query("updated_manifest", "A14 A18", ctes(SNAPSHOTS) + """SELECT repo_id, path, sha256, 'present' AS state FROM new_files
UNION ALL SELECT repo_id, path, NULL, 'deleted' FROM old_files o
 WHERE NOT EXISTS (SELECT 1 FROM new_files n WHERE n.repo_id = o.repo_id AND n.path = o.path)""")
def updated_manifest(spark, sf_dir):
    """Hash of each file after the second snapshot; deleted files keep a row."""
    state = F.when(F.col("sha256").isNull(), "deleted").otherwise("present")
    return updated(spark, sf_dir).heads().withColumn("state", state)


@query("streamed_claims", "A18 S1", _CLAIMS)
def streamed_claims(spark, sf_dir):
    """The same claims where files arrive as a stream: all of the first snapshot, then the changes and deletions of the second."""
    arrivals, checkpoint = shared_path(spark), shared_path(spark)
    claims = claim_table(spark, shared_path(spark))

    def arrive(files: DataFrame) -> None:
        files.write.mode("append").parquet(arrivals)
        stream = jobs.stream_table(spark, arrivals, files.schema, per_trigger=10_000)
        jobs.keep_current(stream, claims, checkpoint).awaitTermination()

    old = stored(_first(spark, sf_dir))
    arrive(old)
    new = stored(_second(spark, sf_dir).withColumn("sha256", F.sha2("content", 256)))
    hashes = stored(old.select("repo_id", "path", F.sha2("content", 256).alias("sha256")))
    arrive(new.join(hashes, ["repo_id", "path", "sha256"], "left_anti").select(*_FILE))
    gone = hashes.join(new.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    nothing = F.lit(None).cast("string")
    arrive(gone.select("repo_id", "path", nothing.alias("language"), nothing.alias("kind"), nothing.alias("content")))
    return _shape(claims.entries())


# Documents as files in bytes: with byte order mark, with malformed bytes, with a NUL byte, under refused names.
_BYTES = """SELECT source AS repo_id, doc_id, concat(CASE doc_id % 9 WHEN 5 THEN 'node_modules/' ELSE '' END, CAST(doc_id AS STRING),
 CASE doc_id % 9 WHEN 3 THEN '.min.js' WHEN 4 THEN '.pem' WHEN 6 THEN '.bin' WHEN 7 THEN '.py' ELSE '.txt' END) AS path, text FROM documents"""


@query("scan_file_bytes", "A1 A7 A8 A9", f"""WITH f AS ({_BYTES}),
 b AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN '\\xEF\\xBB\\xBF'::BLOB || encode(text) WHEN 1 THEN encode(text) || '\\xFF'::BLOB || encode(' tail')
  WHEN 2 THEN '\\x00'::BLOB || encode(text) ELSE encode(text) END AS bytes,
  CASE doc_id % 9 WHEN 1 THEN concat(text, chr(65533), ' tail') ELSE text END AS decoded FROM f),
 r AS (SELECT *, CASE doc_id % 9 WHEN 5 THEN 'ignored' WHEN 4 THEN 'sensitive' WHEN 3 THEN 'generated' WHEN 6 THEN 'unsupported' ELSE
  CASE WHEN bytes IS NULL THEN 'unreadable' WHEN octet_length(bytes) > 524288 THEN 'large' WHEN doc_id % 9 = 2 THEN 'binary' END END AS skip_reason FROM b),
 t AS (SELECT *, CASE WHEN skip_reason IS NULL THEN decoded END AS content FROM r),
 l AS (SELECT *, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS lines FROM t)
SELECT repo_id, path, octet_length(bytes) AS size, sha256(bytes) AS sha256, skip_reason, sha256(content) AS text_sha256,
 (len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END)::INT AS line_count FROM l""")
def scan_file_bytes(spark, sf_dir):
    """Hashes of bytes, reasons to refuse and decoded lines of contents that arrive as bytes."""
    files, case, text = corpus._run(spark, sf_dir, "documents", _BYTES), F.col("doc_id") % 9, F.col("text").cast("binary")
    body = (F.when(case == 0, F.concat(F.unhex(F.lit("EFBBBF")), text)).when(case == 1, F.concat(text, F.unhex(F.lit("FF")), F.lit(" tail").cast("binary")))
            .when(case == 2, F.concat(F.unhex(F.lit("00")), text)).otherwise(text))
    rows = filebytes.scan(files.withColumn("content", body))
    return rows.select("repo_id", "path", "size", "sha256", "skip_reason", F.sha2("content", 256).alias("text_sha256"), "line_count")
