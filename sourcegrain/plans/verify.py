"""Verification queries over two snapshots of the text corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.operators import passages as P
from sourcegrain.operators import verify as V
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import DOCS, NEXT_DOCS, ctes, hash_sql
from sourcegrain.plans.passages import windows_cte
from sourcegrain.plans.registry import query

# Claims of every kind, one per document, by doc_id % 8: right line, other line, wrong line number, missing file,
# invented evidence, masked evidence, unsafe path, cut-off evidence.
_CLAIMS_SQL = """claims AS (SELECT doc_id, repo_id,
 CASE doc_id % 8 WHEN 3 THEN 'gone/file.txt' WHEN 6 THEN concat('../', path) ELSE path END AS path,
 CASE doc_id % 8 WHEN 2 THEN 99999 ELSE CAST(doc_id % 3 + 1 AS INT) END AS line,
 CASE doc_id % 8 WHEN 1 THEN lines[-1] WHEN 2 THEN NULL WHEN 4 THEN concat('invented evidence ', CAST(doc_id AS STRING))
  WHEN 5 THEN concat(substr(lines[1], 1, 4), '[REDACTED]', substr(lines[1], 12, 10))
  WHEN 7 THEN concat(substr(lines[1], 1, 12), '…') ELSE lines[least(doc_id % 3 + 1, len(lines))] END AS evidence,
 sha256 AS indexed FROM docs WHERE len(lines) > 0)"""


def _claims(docs):
    m = F.col("doc_id") % 8
    pick = F.least((F.col("doc_id") % 3 + 1).cast("int"), F.size("lines"))
    first = F.element_at("lines", 1)
    evidence = (F.when(m == 1, F.element_at("lines", -1)).when(m == 2, F.lit(None))
                .when(m == 4, F.concat(F.lit("invented evidence "), F.col("doc_id").cast("string")))
                .when(m == 5, F.concat(F.substring(first, 1, 4), F.lit("[REDACTED]"), F.substring(first, 12, 10)))
                .when(m == 7, F.concat(F.substring(first, 1, 12), F.lit("…"))).otherwise(F.element_at("lines", pick)))
    path = F.when(m == 3, "gone/file.txt").when(m == 6, F.concat(F.lit("../"), F.col("path"))).otherwise(F.col("path"))
    line = F.when(m == 2, 99999).otherwise((F.col("doc_id") % 3 + 1).cast("int"))
    return docs.where(F.size("lines") > 0).select(
        "doc_id", "repo_id", path.alias("path"), line.alias("line"), F.lit(None).cast("int").alias("line_end"),
        evidence.alias("evidence"), F.col("sha256").alias("indexed_sha256"))


def _norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


_LIKE = (f"concat('%', array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace({_norm('evidence')}, "
         "'…$', ''), '[REDACTED]'), lambda p: trim(p)), lambda p: p <> ''), lambda p: replace(replace(replace(p, '!', '!!'), "
         "'%', '!%'), '_', '!_')), '%'), '%')")


def _like(text: str) -> str:
    return f"(coalesce(evidence, '') = '' OR {_norm(text)} LIKE {_LIKE} ESCAPE '!')"


@query("evidence_match", "I1", ctes(DOCS, _CLAIMS_SQL) + f""", j AS (SELECT c.*, d.lines FROM claims c JOIN docs d
 ON d.repo_id = c.repo_id AND d.path = c.path)
SELECT doc_id, {_like("lines[1]")} AS on_first, {_like("array_to_string(lines, chr(10))")} AS in_file FROM j""")
def evidence_match(spark, sf_dir):
    d = inputs.docs(spark, sf_dir)
    j = _claims(d).join(d.select("repo_id", "path", "lines"), ["repo_id", "path"])
    return j.select("doc_id", V.evidence_matches(F.col("evidence"), F.element_at("lines", 1)).alias("on_first"),
                    V.evidence_matches(F.col("evidence"), tx.join_lines(F.col("lines"))).alias("in_file"))


_ANCHOR_SQL = f""", j AS (SELECT c.*, n.lines, n.sha256 AS cur FROM claims c LEFT JOIN next_docs n ON n.repo_id = c.repo_id AND n.path = c.path),
 k AS (SELECT *, line <= len(lines) AS in_range, CASE WHEN line <= len(lines) THEN {_like("lines[line]")} END AS cited FROM j),
 e AS (SELECT k.doc_id, u.i, u.t FROM k, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS t) u
  WHERE coalesce(evidence, '') <> '' AND NOT coalesce(cited, false)
  AND length({_norm("string_split(evidence, chr(10))[1]")}) >= 6),
 f AS (SELECT e.doc_id, min(i)::INT AS found FROM e JOIN k USING (doc_id) WHERE {_like("t")} GROUP BY 1),
 a AS (SELECT k.*, f.found, CASE WHEN path LIKE '../%' THEN 'unsafe_path' WHEN lines IS NULL THEN 'missing'
  WHEN NOT in_range AND found IS NULL THEN 'invalid_line' WHEN NOT coalesce(cited, false) AND found IS NULL THEN 'unsupported'
  WHEN indexed = cur THEN 'verified' ELSE 'stale' END AS status FROM k LEFT JOIN f USING (doc_id))"""
_ANCHORS = ctes(DOCS, NEXT_DOCS, _CLAIMS_SQL) + _ANCHOR_SQL


@query("anchor_claims", "I2 I3 I7", _ANCHORS + """
SELECT doc_id, status, coalesce(found, line) AS line, CASE WHEN status IN ('verified', 'stale') AND found IS NOT NULL THEN line END
 AS relocated_from, CASE WHEN status IN ('verified', 'stale') THEN sha256(regexp_replace(lines[coalesce(found, line)], '\\s+$', ''))
 ELSE '' END AS evidence_sha256 FROM a""")
def anchor_claims(spark, sf_dir):
    return V.anchor(_claims(inputs.docs(spark, sf_dir)), inputs.next_docs(spark, sf_dir)).select(
        "doc_id", "status", "line", "relocated_from", "evidence_sha256")


_CITED = """cites AS (SELECT row_number() OVER () AS x, repo_id, path, line_start::INT AS line_start, line_end::INT AS line_end,
 sha AS esha, fsha FROM (SELECT w.*, d.sha256 AS fsha FROM w JOIN docs d USING (repo_id, path)))"""
_VERIFY_SQL = ctes(DOCS, NEXT_DOCS, windows_cte("docs", "w", 5, 5), _CITED) + f""", j AS (SELECT c.*, n.lines, n.sha256 AS cur,
 {hash_sql('n.lines[c.line_start:c.line_end]')} AS now FROM cites c LEFT JOIN next_docs n USING (repo_id, path)),
 s AS (SELECT *, CASE WHEN lines IS NULL THEN 'missing' WHEN line_start > len(lines) OR now <> esha THEN 'stale' ELSE 'verified' END
 AS status FROM j),
 r AS (SELECT x, min(i)::INT AS moved FROM (SELECT x, esha, {hash_sql('lines[i:i + line_end - line_start]')} AS h, i FROM (SELECT *,
  unnest(range(1, greatest(len(lines) - (line_end - line_start) + 1, 1))) AS i FROM s WHERE status = 'stale')) WHERE h = esha GROUP BY x)"""


def _citations(spark, sf_dir):
    d = inputs.docs(spark, sf_dir).withColumnRenamed("sha256", "file_sha256")
    w = P.windows(d, window=5, step=5, keep=("repo_id", "path", "doc_id", "file_sha256"))
    return w.select("repo_id", "path", "doc_id", "line_start", "line_end", F.col("sha256").alias("evidence_sha256"), "file_sha256")


@query("verify_citations", "I4 I5", _VERIFY_SQL + """
SELECT repo_id, path, line_start, status, moved AS relocated_line, coalesce(cur <> fsha, true) AS file_changed FROM s LEFT JOIN r USING (x)""")
def verify_citations(spark, sf_dir):
    return V.verify(_citations(spark, sf_dir), inputs.next_docs(spark, sf_dir)).select(
        "repo_id", "path", "line_start", "status", "relocated_line", "file_changed")


@query("worst_status_per_file", "I6", _VERIFY_SQL + """
SELECT repo_id, path, CASE max(CASE status WHEN 'verified' THEN 0 WHEN 'stale' THEN 1 ELSE 3 END) WHEN 0 THEN 'verified'
 WHEN 1 THEN 'stale' ELSE 'missing' END AS status FROM s GROUP BY 1, 2""")
def worst_status_per_file(spark, sf_dir):
    return (V.verify(_citations(spark, sf_dir), inputs.next_docs(spark, sf_dir)).groupBy("repo_id", "path")
            .agg(V.worst_status(F.col("status")).alias("status")))


@query("reverify_findings", "I8 I9", _VERIFY_SQL + """, f AS (SELECT repo_id, path, max(CASE WHEN line_start = 1 THEN status END) AS own,
 max(CASE status WHEN 'verified' THEN 0 WHEN 'stale' THEN 1 ELSE 3 END) AS worst FROM s GROUP BY 1, 2)
SELECT concat(repo_id, ':', path) AS finding_id, CASE worst WHEN 0 THEN 'verified' WHEN 1 THEN 'stale' ELSE 'missing' END AS status,
 own AS own_status FROM f""")
def reverify_findings(spark, sf_dir):
    c = _citations(spark, sf_dir).withColumn("finding_id", F.concat_ws(":", "repo_id", "path"))
    out = V.reverify_findings(c.where("line_start = 1"), c.where("line_start > 1"), inputs.next_docs(spark, sf_dir))
    return out.select("finding_id", "status", "own_status")


@query("drifted_files", "I10", ctes(DOCS, NEXT_DOCS) + """SELECT repo_id, path FROM docs d JOIN next_docs n USING (repo_id, path)
 WHERE d.sha256 <> n.sha256""")
def drifted_files(spark, sf_dir):
    old = inputs.docs(spark, sf_dir).select("repo_id", "path", F.col("sha256").alias("old_sha"))
    new = inputs.next_docs(spark, sf_dir).select("repo_id", "path", F.col("sha256").alias("new_sha"))
    return old.join(new, ["repo_id", "path"]).where("old_sha <> new_sha").select("repo_id", "path")
