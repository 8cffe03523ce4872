"""Scans: admission, classification, lines, hashes, listing checks, snapshots of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, DOC_LINES, DOCS, NEXT_DOCS, ctes, hash_sql, split_sql
from sourcegrain.plans.registry import query
from sourcegrain.sources import corpus, external, listing, tables
from sourcegrain.sources.corpus import table


@query("scan_corpus_files", "A1 A8 A9", ctes(DOCS) + """
SELECT repo_id, path, size, len(lines) AS line_count, sha256 FROM docs""")
def scan_corpus_files(spark, sf_dir):
    return inputs.docs(spark, sf_dir).select("repo_id", "path", "size", "line_count", "sha256")


@query("decode_number_lines", "A8", ctes(DOCS, DOC_LINES) + "SELECT repo_id, path, line_no, line FROM doc_lines")
def decode_number_lines(spark, sf_dir):
    return corpus.explode_lines(inputs.docs(spark, sf_dir))


# A listing of odd paths, derived from part: one entry of each shape per eight rows.
_LISTING = """SELECT CAST(p_partkey % 5 AS STRING) AS repo_id, p_partkey AS pos,
 concat(CASE p_partkey % 12 WHEN 0 THEN 'src/.env' WHEN 1 THEN 'node_modules/a/x' WHEN 2 THEN 'env/pyvenv.cfg'
  WHEN 3 THEN 'env/lib/mod' WHEN 4 THEN 'certs/server.pem' WHEN 5 THEN 'web/app.min.js' WHEN 6 THEN 'img/logo.png'
  WHEN 7 THEN 'src/.env.example' WHEN 8 THEN 'docker-compose.yml' WHEN 9 THEN '.github/workflows/ci.yml'
  WHEN 10 THEN 'src/tests/test_mod.py' ELSE 'Dockerfile.dev' END,
  CASE p_partkey % 12 WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 3 THEN concat(CAST(p_partkey AS STRING), '.py')
  ELSE '' END) AS path,
 CAST(p_partkey * 700 AS BIGINT) AS size, p_partkey % 29 = 0 AS is_symlink, p_partkey % 31 = 0 AS unreadable,
 p_partkey % 37 = 0 AS is_binary FROM part"""


def _entries(spark, sf_dir):
    return corpus._run(spark, sf_dir, "part", _LISTING)


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SENSITIVE = (f"(lower({_NAME}) NOT IN ('.env.example') AND (lower({_NAME}) = '.env' "
              f"OR starts_with(lower({_NAME}), '.env.') OR regexp_matches(lower({_NAME}), '\\.pem$')))")
_REASON = f"""CASE WHEN is_symlink THEN 'symlinks' WHEN {_SENSITIVE} THEN 'sensitive'
 WHEN path LIKE '%.min.js' THEN 'generated' WHEN path LIKE '%.png' OR path LIKE 'node_modules/%' THEN 'unsupported'
 WHEN unreadable THEN 'unreadable' WHEN size > 524288 THEN 'large' WHEN is_binary THEN 'binary' END"""


@query("admission_skip_reasons", "A2 A4 A5", f"""SELECT coalesce({_REASON}, 'admitted') AS reason, count(*) AS files,
 sum(size)::BIGINT AS bytes FROM ({_LISTING}) GROUP BY 1""")
def admission_skip_reasons(spark, sf_dir):
    return (listing.admission(_entries(spark, sf_dir))
            .groupBy(F.coalesce("skip_reason", F.lit("admitted")).alias("reason"))
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes")))


@query("sensitive_names", "A4", f"SELECT repo_id, pos, path FROM ({_LISTING}) WHERE {_SENSITIVE}")
def sensitive_names(spark, sf_dir):
    return (_entries(spark, sf_dir).where(listing.is_sensitive(tx.base_name(F.col("path"))))
            .select("repo_id", "pos", "path"))


@query("generated_names", "A5", f"SELECT repo_id, pos, path FROM ({_LISTING}) WHERE path LIKE '%.min.js'")
def generated_names(spark, sf_dir):
    return (_entries(spark, sf_dir).where(listing.is_generated(tx.base_name(F.col("path"))))
            .select("repo_id", "pos", "path"))


@query("prune_ignored_dirs", "A3", f"""WITH l AS ({_LISTING}), v AS (SELECT DISTINCT repo_id FROM l
 WHERE path = 'env/pyvenv.cfg')
SELECT repo_id, count(*) AS files FROM l WHERE path NOT LIKE 'node_modules/%'
 AND NOT (path LIKE 'env/%' AND repo_id IN (SELECT repo_id FROM v)) GROUP BY 1""")
def prune_ignored_dirs(spark, sf_dir):
    return listing.prune_ignored(_entries(spark, sf_dir)).groupBy("repo_id").agg(F.count("*").alias("files"))


@query("ignored_dir_count", "A3", f"""SELECT repo_id, count(DISTINCT 'node_modules') AS ignored_dirs
 FROM ({_LISTING}) WHERE path LIKE 'node_modules/%' GROUP BY 1""")
def ignored_dir_count(spark, sf_dir):
    top = _entries(spark, sf_dir).select("repo_id", listing.topmost_ignored(F.col("path")).alias("top"))
    return top.where("top IS NOT NULL").groupBy("repo_id").agg(F.countDistinct("top").alias("ignored_dirs"))


@query("file_limit_walk_order", "A2", ctes(CODE) + """, keyed AS (SELECT repo_id, path,
 CASE WHEN strpos(path, '/') = 0 THEN concat('0', path)
  ELSE concat('1', regexp_extract(path, '^([^/]*)', 1), chr(1), '0', regexp_extract(path, '([^/]*)$', 1)) END AS k
 FROM code)
SELECT repo_id, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY k) AS rn FROM keyed)
WHERE rn <= 30""")
def file_limit_walk_order(spark, sf_dir):
    return listing.limit_files(corpus.code_files(spark, sf_dir).select("repo_id", "path"), 30)


@query("classify_files", "A6", ctes(CODE) + """SELECT repo_id, path, language, kind,
 CASE WHEN path LIKE 'tests/%' THEN 'test' WHEN path = 'README.md' THEN 'readme'
  WHEN path IN ('package.json', 'requirements.txt') THEN 'manifest' WHEN kind = 'config' THEN 'config'
  ELSE '' END AS tags FROM code""")
def classify_files(spark, sf_dir):
    return inputs.code(spark, sf_dir).select("repo_id", "path", "language", "kind",
                                             F.array_join("tags", ",").alias("tags"))


@query("classify_listing", "A6", f"""SELECT repo_id, pos,
 CASE p WHEN 7 THEN 'dotenv' WHEN 8 THEN 'yaml' WHEN 9 THEN 'yaml' WHEN 10 THEN 'python' WHEN 3 THEN 'python'
  WHEN 2 THEN 'ini' WHEN 5 THEN 'javascript' WHEN 11 THEN 'dockerfile' END AS language,
 CASE p WHEN 7 THEN 'config' WHEN 8 THEN 'config' WHEN 9 THEN 'config' WHEN 10 THEN 'source' WHEN 3 THEN 'source'
  WHEN 2 THEN 'config' WHEN 5 THEN 'source' WHEN 11 THEN 'config' END AS kind,
 CASE p WHEN 7 THEN 'config' WHEN 8 THEN 'compose,config' WHEN 9 THEN 'ci,config' WHEN 10 THEN 'test'
  WHEN 2 THEN 'config' WHEN 11 THEN 'dockerfile,config' ELSE '' END AS tags
FROM (SELECT *, pos % 12 AS p FROM ({_LISTING}))""")
def classify_listing(spark, sf_dir):
    return listing.classify(_entries(spark, sf_dir)).select("repo_id", "pos", "language", "kind",
                                                            F.array_join("tags", ",").alias("tags"))


@query("binary_sniff", "A7", """SELECT page_id, page_id % 4 = 0 AND octet_length(encode(html)) < 8192 AS is_binary,
 sha256(CASE WHEN page_id % 4 = 0 THEN concat(html, chr(0), 'tail') ELSE html END) AS sha256 FROM pages""")
def binary_sniff(spark, sf_dir):
    raw = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("\u0000tail"))).otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", raw.cast("binary").alias("content"))
    return pages.select("page_id", tx.is_binary(F.col("content")).alias("is_binary"),
                        F.sha2("content", 256).alias("sha256"))


@query("text_sha256", "A9", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("manifest_dependencies", "A10", ctes(CODE) + """SELECT repo_id, path, dep, version, main FROM (
 SELECT repo_id, path, json_extract_string(content, '$.main') AS main, unnest([
  {'dep': 'express', 'version': json_extract_string(content, '$.dependencies.express')},
  {'dep': 'pg', 'version': json_extract_string(content, '$.dependencies.pg')},
  {'dep': 'left-pad', 'version': json_extract_string(content, '$.dependencies."left-pad"')},
  {'dep': 'react', 'version': json_extract_string(content, '$.devDependencies.react')}], recursive := true)
 FROM code WHERE path = 'package.json')""")
def manifest_dependencies(spark, sf_dir):
    return external.package_manifests(corpus.code_files(spark, sf_dir))


@query("external_findings_import", "A11", """WITH raw AS (SELECT event_id, event_type, user_id, value FROM events),
 mapped AS (SELECT event_id, concat(event_type, ' issue') AS title, concat('app/u', CAST(user_id AS STRING), '.py') AS file,
  CAST(event_id % 90 + 1 AS INT) AS line,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'info' WHEN 'signup' THEN 'medium'
   ELSE 'low' END AS severity FROM raw)
SELECT title, file, severity, line FROM (SELECT *, row_number() OVER (PARTITION BY title, file ORDER BY event_id) AS rn
 FROM mapped) WHERE rn = 1""")
def external_findings_import(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    loc = F.concat(F.lit("./app/u"), F.col("user_id").cast("string"), F.lit(".py"))
    title = F.concat("event_type", F.lit(" issue"))
    line = (F.col("event_id") % 90 + 1).cast("string")
    sev = (F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "click", "moderate")
           .when(F.col("event_type") == "view", "informational").when(F.col("event_type") == "signup", "odd")
           .otherwise("low"))
    # three aliased shapes of the same record, as different scanner versions write them
    item = (F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(title.alias("title"), sev.alias("severity"),
                                                                  loc.alias("file"), line.alias("line"))))
            .when(F.col("event_id") % 3 == 1, F.to_json(F.struct(title.alias("name"), sev.alias("risk"),
                                                                 F.concat(loc, F.lit(":"), line).alias("location"))))
            .otherwise(F.to_json(F.struct(title.alias("vulnerability"), sev.alias("severity"),
                                          loc.alias("file_path"), line.alias("line_number")))))
    payload = F.concat(F.lit('{"results":['), item, F.lit("]}"))
    runs = e.select(F.lit("run").alias("run_id"), F.col("event_id").alias("pos"), payload.alias("payload"))
    return external.import_findings(runs).select("title", "file", "severity", "line")


_UNSAFE = ["a/b.js", "../evil.js", "/etc/x.js", "a/../../e.js", "C:/x.js", "  ", "./", "a//./b.js", "a\\b.js"]
_UNSAFE_CASE = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_UNSAFE))
_UNSAFE_SQL = f"SELECT p_partkey AS pos, CASE p_partkey % {len(_UNSAFE)} {_UNSAFE_CASE} END AS path FROM part"


@query("listing_safety", "A12 I7", f"""WITH l AS ({_UNSAFE_SQL.replace("'a\\b.js'", "concat('a', chr(92), 'b.js')")})
SELECT pos, CASE pos % 9 WHEN 1 THEN 'traversal' WHEN 2 THEN 'absolute' WHEN 3 THEN 'traversal' WHEN 4 THEN 'absolute'
 WHEN 5 THEN 'empty' WHEN 6 THEN 'empty' END AS unsafe_reason,
 CASE WHEN pos % 9 IN (0, 7, 8) THEN 'a/b.js' END AS normalized FROM l""")
def listing_safety(spark, sf_dir):
    paths = F.array(*[F.lit(p) for p in _UNSAFE])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.element_at(paths, (F.col("p_partkey") % len(_UNSAFE) + 1).cast("int")).alias("path"))
    return rows.select("pos", listing.unsafe_reason(F.col("path")).alias("unsafe_reason"),
                       listing.normalize_path(F.col("path")).alias("normalized"))


_ARCHIVE = """SELECT CAST(p_partkey % 7 AS STRING) AS archive_id, p_partkey AS pos,
 concat('root/', CASE WHEN p_partkey % 10 = 0 THEN 'dist/x.js' WHEN p_partkey % 7 = 6 AND p_partkey % 70 = 6
  THEN '../e.js' ELSE concat('m', CAST(p_partkey AS STRING), '.js') END) AS path,
 CAST(p_partkey % 100 * 1000 AS BIGINT) AS size, p_partkey % 33 = 0 AS is_symlink FROM part"""


@query("listing_budget", "A13", f"""WITH l AS (SELECT *, CASE WHEN is_symlink THEN 'symlink' WHEN path LIKE '%../%' THEN 'unsafe'
 WHEN path LIKE '%dist/%' THEN 'ignored' WHEN size > 90000 THEN 'large' ELSE 'taken' END AS c FROM ({_ARCHIVE})),
 g AS (SELECT archive_id, count(*) AS entries, count(*) FILTER (WHERE c = 'symlink') AS skipped_symlinks,
 count(*) FILTER (WHERE c = 'ignored') AS skipped_ignored, count(*) FILTER (WHERE c = 'large') AS skipped_large,
 count(*) FILTER (WHERE c = 'taken') AS files, coalesce(sum(size) FILTER (WHERE c = 'taken'), 0)::BIGINT AS bytes,
 count(*) FILTER (WHERE c = 'unsafe') AS unsafe FROM l GROUP BY 1)
SELECT *, true AS single_root, CASE WHEN entries > 100000 THEN 'too_many_entries' WHEN unsafe > 0 THEN 'unsafe_path'
 WHEN bytes > 9000000 THEN 'too_large' WHEN files = 0 THEN 'no_files' ELSE 'ok' END AS verdict FROM g""")
def listing_budget(spark, sf_dir):
    entries = corpus._run(spark, sf_dir, "part", _ARCHIVE)
    return listing.archive_budget(entries, max_entries=100000, max_member=90000, max_total=9000000)


@query("replace_file_index", "A14", ctes(DOCS, NEXT_DOCS) + """
SELECT repo_id, path, sha256 FROM docs WHERE repo_id NOT IN (SELECT repo_id FROM next_docs)
UNION ALL SELECT repo_id, path, sha256 FROM next_docs""")
def replace_file_index(spark, sf_dir):
    current = inputs.docs(spark, sf_dir).select("repo_id", "path", "sha256")
    incoming = inputs.next_docs(spark, sf_dir).select("repo_id", "path", "sha256")
    return tables.replace_partitions(current, incoming, ["repo_id"])


@query("replace_rows_by_type", "A15", ctes(DOCS) + """
SELECT repo_id, kind, count(*) AS n FROM (
 SELECT repo_id, path, CASE WHEN doc_id % 3 = 0 THEN 'finding' ELSE 'code' END AS kind FROM docs
  WHERE doc_id % 3 <> 0 UNION ALL
 SELECT repo_id, path, 'finding' FROM docs WHERE doc_id % 2 = 0) GROUP BY 1, 2""")
def replace_rows_by_type(spark, sf_dir):
    d = inputs.docs(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 3 == 0, "finding").otherwise("code")
    old = d.select("repo_id", kind.alias("kind"), "path")
    new = d.where("doc_id % 2 = 0").select("repo_id", F.lit("finding").alias("kind"), "path")
    kept = tables.drop_types(old, ["finding"], "kind").unionByName(new)
    return kept.groupBy("repo_id", "kind").agg(F.count("*").alias("n"))


@query("update_verification_status", "A15", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'stale' ELSE 'verified' END
 AS status FROM events""")
def update_verification_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.lit("verified").alias("status"))
    updates = e.where("event_id % 4 = 0").select("event_id", F.lit("stale").alias("status"))
    return tables.upsert(rows, updates, ["event_id"])


@query("recent_repositories", "A16", """SELECT user_id, max(ts) AS created_at FROM events GROUP BY user_id
 ORDER BY created_at DESC, user_id LIMIT 12""")
def recent_repositories(spark, sf_dir):
    repos = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("created_at"))
    return repos.orderBy(F.desc("created_at"), "user_id").limit(12)


@query("list_rows_by_key", "A17", """SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'click')
 ORDER BY event_type, event_id""")
def list_rows_by_key(spark, sf_dir):
    return tables.list_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"),
                            {"event_type": ["error", "click"]}, ["event_type", "event_id"])


@query("incremental_rescan", "A18 I10", ctes(DOCS, NEXT_DOCS) + """
SELECT repo_id, path, sha256 FROM next_docs n WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.repo_id = n.repo_id
 AND d.path = n.path AND d.sha256 = n.sha256)""")
def incremental_rescan(spark, sf_dir):
    old = inputs.docs(spark, sf_dir).select("repo_id", "path", "sha256")
    new = inputs.next_docs(spark, sf_dir).select("repo_id", "path", "sha256")
    return tables.changed_files(old, new)
