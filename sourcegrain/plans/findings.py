"""Cross-validation and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.operators import findings as K
from sourcegrain.operators import verify as V
from sourcegrain.operators.rules import scan
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, SNAPSHOTS, ctes
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import CODE_CLAIMS, claims_cte, code_claims
from sourcegrain.session import stored
from sourcegrain.sources.corpus import explode_lines

# Three detectors report on the code corpus: the rules, a reviewer without families, a reviewer with another family.
DETECTED = """d AS (SELECT repo_id, 'security' AS category, path, line_no AS line, line_no AS line_end, family, severity, title, rule_id,
  CASE WHEN line_no % 5 = 0 THEN 'invented evidence' ELSE evidence END AS evidence, confidence, 'rule' AS source,
  concat('rule:', rule_id) AS detector, rule_order * 10 AS claim_order FROM claims
 UNION ALL SELECT repo_id, 'security', path, line_no, line_no, NULL, 'critical', concat(title, ' (review)'), rule_id, evidence, 0.6, 'review',
  'reviewer', rule_order * 10 + 1 FROM claims WHERE rule_order % 2 = 0
 UNION ALL SELECT repo_id, 'security', path, line_no, line_no, 'other', 'low', 'Other', rule_id, evidence, 0.5, 'review',
  'second', rule_order * 10 - 1 FROM claims WHERE rule_order % 3 = 0)"""


def detected(spark, sf_dir):
    def report(family, severity, title, evidence, confidence, source, detector, shift, when=None):
        row = F.struct(family.cast("string").alias("family"), severity.alias("severity"), title.alias("title"), evidence.alias("evidence"),
                       confidence.alias("confidence"), F.lit(source).alias("source"), detector.alias("detector"),
                       (F.col("rule_order") * 10 + shift).alias("claim_order"))
        return row if when is None else F.when(when, row)
    ev = F.col("evidence")
    rule = report(F.col("family"), F.col("severity"), F.col("title"), F.when(F.col("line_no") % 5 == 0, "invented evidence").otherwise(ev),
                  F.col("confidence"), "rule", F.concat(F.lit("rule:"), "rule_id"), 0)
    review = report(F.lit(None), F.lit("critical"), F.concat("title", F.lit(" (review)")), ev, F.lit(0.6), "review", F.lit("reviewer"), 1,
                    F.col("rule_order") % 2 == 0)
    second = report(F.lit("other"), F.lit("low"), F.lit("Other"), ev, F.lit(0.5), "review", F.lit("second"), -1, F.col("rule_order") % 3 == 0)
    rows = code_claims(spark, sf_dir).select("repo_id", "path", F.col("line_no").alias("line"), "rule_id",
                                             F.explode(F.array(rule, review, second)).alias("r")).where("r IS NOT NULL")
    return rows.select("repo_id", F.lit("security").alias("category"), "path", "line", F.col("line").alias("line_end"), "rule_id", "r.*")


_BASE = CODE_CLAIMS + ", " + DETECTED
_ACCEPT = """acc AS (SELECT * FROM d WHERE evidence <> 'invented evidence')"""
_MERGE = """fam AS (SELECT *, first_value(family) OVER (PARTITION BY repo_id, path, line ORDER BY claim_order) AS f1 FROM acc),
 key AS (SELECT *, CASE WHEN f1 IS NULL THEN '*' ELSE coalesce(family, f1) END AS cluster FROM fam),
 o AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sr FROM key),
 n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, cluster ORDER BY sr, source <> 'rule', -confidence, claim_order) AS rn,
  count(*) OVER (PARTITION BY repo_id, path, line, cluster) AS cnt, max(confidence) OVER (PARTITION BY repo_id, path, line, cluster) AS top FROM o),
 dt AS (SELECT repo_id, path, line, cluster, detector, min(rn) AS pos FROM n GROUP BY ALL),
 dl AS (SELECT repo_id, path, line, cluster, string_agg(detector, ',' ORDER BY pos) AS detectors FROM dt GROUP BY ALL),
 sv AS (SELECT repo_id, path, line, cluster, count(DISTINCT severity) AS severities FROM n GROUP BY ALL),
 merged AS (SELECT n.repo_id, n.category, n.path, n.line, n.title, n.severity, n.family, n.rule_id, n.evidence, n.cnt AS merged_from, dl.detectors, sv.severities,
  CASE WHEN cnt = 1 THEN confidence ELSE least(0.99, top + 0.04 * (cnt - 1)) END AS confidence
  FROM n JOIN dl USING (repo_id, path, line, cluster) JOIN sv USING (repo_id, path, line, cluster) WHERE rn = 1)"""


def crosschecked(spark, sf_dir):
    claims = stored(detected(spark, sf_dir).withColumn("indexed_sha256", F.lit(None).cast("string")))
    accepted, rejected = K.filter_claims(claims, inputs.code(spark, sf_dir))
    return claims, accepted, rejected, K.merge_claims(accepted)


@query("claim_filter", "J1", _BASE + """ SELECT repo_id, source, CASE WHEN evidence = 'invented evidence' THEN 'unsupported' ELSE 'verified' END AS status,
 count(*) AS n FROM d GROUP BY 1, 2, 3""")
def claim_filter(spark, sf_dir):
    _, accepted, rejected, _ = crosschecked(spark, sf_dir)
    return accepted.unionByName(rejected).groupBy("repo_id", "source", "status").agg(F.count("*").alias("n"))


@query("merge_claims", "J2", _BASE + ", " + _ACCEPT + ", " + _MERGE + """ SELECT repo_id, path, line, title, severity, family, merged_from, detectors,
 round(confidence, 6) AS confidence FROM merged""")
def merge_claims(spark, sf_dir):
    merged = crosschecked(spark, sf_dir)[3]
    return merged.select("repo_id", "path", "line", "title", "severity", "family", "merged_from", F.array_join("detectors", ",").alias("detectors"),
                         F.round("confidence", 6).alias("confidence"))


@query("severity_conflicts", "J3", _BASE + ", " + _ACCEPT + ", " + _MERGE + " SELECT repo_id, path, line, severity, severities FROM merged WHERE severities > 1")
def severity_conflicts(spark, sf_dir):
    return K.conflicts(crosschecked(spark, sf_dir)[3]).select("repo_id", "path", "line", "severity", F.col("severities").cast("long").alias("severities"))


@query("validation_counters", "J5", _BASE + ", " + _ACCEPT + ", " + _MERGE + """, u AS (SELECT repo_id, 'claims' AS "check" FROM d
 UNION ALL SELECT repo_id, 'evidence at the cited line' FROM acc UNION ALL SELECT repo_id, 'duplicate detections merged' FROM merged WHERE merged_from > 1
 UNION ALL SELECT repo_id, 'severity conflicts resolved' FROM merged WHERE severities > 1
 UNION ALL SELECT repo_id, 'unsupported claims rejected' FROM d WHERE evidence = 'invented evidence')
 SELECT repo_id, "check", count(*) AS value FROM u GROUP BY 1, 2""")
def validation_counters(spark, sf_dir):
    return K.check_counters(*crosschecked(spark, sf_dir))


_FP = r"""left(sha256(concat_ws('|', category, regexp_replace(lower(rule_id), '\d+', 'N', 'g'), path, lower(trim(regexp_replace(evidence, '\s+', ' ', 'g'))))), 16)"""
IDENTITY = f"""fp AS (SELECT *, {_FP} AS fingerprint FROM merged),
 pos AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
  path, line, fingerprint) - 1 AS position FROM fp),
 ident AS (SELECT *, left(sha256(concat_ws('|', repo_id, fingerprint, path, line, position)), 16) AS finding_id FROM pos)"""
_IDENT = _BASE + ", " + _ACCEPT + ", " + _MERGE + ", " + IDENTITY


def code_findings(spark, sf_dir):
    return K.with_identity(crosschecked(spark, sf_dir)[3])


@query("finding_identity", "K1 K2 K3 J5", _IDENT + " SELECT repo_id, path, line, title, fingerprint, position, finding_id FROM ident")
def finding_identity(spark, sf_dir):
    return code_findings(spark, sf_dir).select("repo_id", "path", "line", "title", "fingerprint", "position", "finding_id")


@query("number_findings", "K5", _IDENT + """ SELECT repo_id, finding_id, row_number() OVER (PARTITION BY repo_id ORDER BY
 CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, category, path, line, finding_id) AS number FROM ident""")
def number_findings(spark, sf_dir):
    return K.number_findings(code_findings(spark, sf_dir)).select("repo_id", "finding_id", "number")


# Rule findings of all lines of both corpora, in both snapshots.
def _findings_sql(name, lines):
    hits = claims_cte(lines, f"{name}_hits")
    return f"""{hits}, {name} AS (SELECT h.*, line_no AS line, l.line AS text, l.sha256, {_FP} AS fingerprint,
 row_number() OVER (PARTITION BY repo_id, path, {_FP} ORDER BY line_no, rule_order) AS occurrence
 FROM (SELECT *, 'security' AS category FROM {name}_hits) h JOIN {lines} l USING (repo_id, path, line_no))"""


def snapshot_findings(files):
    """Findings of the whole-text scan of ``files``, with the hash of each line cited. No shuffle."""
    lines = explode_lines(files, "repo_id", "path", "kind", "language", "sha256").withColumn("text", F.col("line"))
    return K.from_hits(scan(lines))


def both_findings(spark, sf_dir):
    """Stored findings of the first snapshot, those of the second one, and the files of the second."""
    before, after = inputs.snapshots(spark, sf_dir)
    old = stored(snapshot_findings(before).withColumn("analysis_order", F.struct("line", "rule_order")))
    return old, snapshot_findings(after), after


def _states(spark, sf_dir):
    old, new, _ = both_findings(spark, sf_dir)
    return K.lifecycle(old, new)


_BOTH = ctes(SNAPSHOTS, _findings_sql("old_f", "old_lines"), _findings_sql("new_f", "new_lines"))
_STATES = """st AS (SELECT repo_id, fingerprint, max_by(title, line * 1000 + rule_order) AS title, 'resolved' AS state FROM old_f
  WHERE fingerprint NOT IN (SELECT fingerprint FROM new_f) GROUP BY 1, 2
 UNION ALL SELECT repo_id, fingerprint, title, CASE WHEN repo_id NOT IN (SELECT repo_id FROM old_f) THEN 'first'
  WHEN fingerprint IN (SELECT fingerprint FROM old_f) THEN 'unchanged' ELSE 'new' END FROM new_f)"""


@query("finding_lifecycle", "K4", _BOTH + ", " + _STATES + " SELECT repo_id, fingerprint, state FROM st")
def finding_lifecycle(spark, sf_dir):
    return _states(spark, sf_dir).select("repo_id", "fingerprint", "state")


@query("lifecycle_counts", "K4", _BOTH + ", " + _STATES + """ SELECT repo_id, count(*) FILTER (WHERE state = 'resolved') AS resolved, count(*) FILTER (WHERE state = 'new') AS "new",
 count(*) FILTER (WHERE state = 'unchanged') AS unchanged, count(*) FILTER (WHERE state = 'first') AS "first" FROM st GROUP BY 1""")
def lifecycle_counts(spark, sf_dir):
    return K.lifecycle_counts(_states(spark, sf_dir))


@query("finding_occurrences", "K4", _BOTH + """ SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path,
 coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(o.occurrence, n.occurrence) AS occurrence, o.line AS old_line, n.line,
 CASE WHEN n.path IS NULL THEN 'resolved' WHEN coalesce(o.repo_id, n.repo_id) NOT IN (SELECT repo_id FROM old_f) THEN 'first'
  WHEN o.path IS NULL THEN 'new' ELSE 'unchanged' END AS state
 FROM old_f o FULL JOIN new_f n ON o.repo_id = n.repo_id AND o.path = n.path AND o.fingerprint = n.fingerprint AND o.occurrence = n.occurrence""")
def finding_occurrences(spark, sf_dir):
    """Equal findings of one file, matched one to one across the snapshots."""
    old, new, _ = both_findings(spark, sf_dir)
    return K.occurrence_lifecycle(old, new).drop("title")


@query("insight_rows", "K6", _IDENT + ", " + _BOTH.removeprefix("WITH ").replace(CODE + ",", "") + ", " + _STATES + """ SELECT repo_id, 'finding' AS memory_type,
 concat('Security finding (', severity, '): ', title, ' at ', path, ':', line, '.') AS content FROM ident
 UNION ALL SELECT repo_id, 'history', concat('Resolved since the previous analysis: ', title, '.') FROM st WHERE state = 'resolved'""")
def insight_rows(spark, sf_dir):
    return K.insight_rows(crosschecked(spark, sf_dir)[3], _states(spark, sf_dir))


def _checked(spark, sf_dir):
    old, _, after = both_findings(spark, sf_dir)
    return V.verify(old.withColumnRenamed("line", "line_start").withColumn("line_end", F.col("line_start")), after)


_CHECKED = ctes(SNAPSHOTS, _findings_sql("old_f", "old_lines")) + r""", ck AS (SELECT o.*, CASE WHEN f.path IS NULL THEN 'missing'
 WHEN n.line IS NULL OR regexp_replace(o.text, '\s+$', '') <> regexp_replace(n.line, '\s+$', '') THEN 'stale' ELSE 'verified' END AS status
 FROM old_f o LEFT JOIN new_files f USING (repo_id, path) LEFT JOIN new_lines n ON n.repo_id = o.repo_id AND n.path = o.path AND n.line_no = o.line)"""


@query("repository_metrics", "K7", _CHECKED + """ SELECT f.repo_id, f.files, coalesce(c.total, 0) AS security, 0::BIGINT AS duplicate, coalesce(c.verified, 0) AS verified,
 coalesce(c.stale, 0) AS stale, coalesce(c.total, 0) AS total FROM (SELECT repo_id, count(*) AS files FROM old_files GROUP BY 1) f
 LEFT JOIN (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'stale') AS stale
  FROM ck GROUP BY 1) c USING (repo_id)""")
def repository_metrics(spark, sf_dir):
    return K.repository_metrics(_checked(spark, sf_dir), inputs.snapshots(spark, sf_dir)[0])


@query("verification_breakdown", "K9", _CHECKED + """ SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified,
 count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'missing') AS missing, 0::BIGINT AS other FROM ck GROUP BY 1""")
def verification_breakdown(spark, sf_dir):
    return K.verification_breakdown(_checked(spark, sf_dir))


@query("finding_list_filter", "K8", _CHECKED + " SELECT repo_id, path, line, rule_id, status FROM ck WHERE status <> 'verified' AND severity = 'high'")
def finding_list_filter(spark, sf_dir):
    rows = K.visible(_checked(spark, sf_dir), "security", "stale", "high")
    return rows.select("repo_id", "path", F.col("line_start").alias("line"), "rule_id", "status")


# Findings of one rule with the same evidence in several places of a repository are one claim with locations.
_CLAIM_ID = r"""left(sha256(concat_ws('|', repo_id, rule_id, trim(regexp_replace(evidence, '\s+', ' ', 'g')))), 16)"""
_SQUASHED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PARTS = ("string_split(regexp_replace(" + _SQUASHED.format("evidence") + ", '…$', ''), '[REDACTED]')")
_LIKE = ("concat('%', array_to_string(list_filter(list_transform(" + _PARTS
         + r", lambda x: trim(replace(replace(replace(x, '\', '\\'), '%', '\%'), '_', '\_'))), lambda x: x <> ''), '%'), '%')")


@query("located_claims", "J1", ctes(SNAPSHOTS, _findings_sql("old_f", "old_lines")) + f""", loc AS (SELECT {_CLAIM_ID} AS claim_id, repo_id, path, line, {_LIKE} AS pat,
 length({_SQUASHED.format('evidence')}) >= 6 AS may_move FROM old_f),
 sq AS (SELECT repo_id, path, line_no, {_SQUASHED.format('line')} AS line FROM new_lines WHERE (repo_id, path) IN (SELECT (repo_id, path) FROM old_f)),
 ok AS (SELECT l.claim_id, l.path, l.line, l.pat, bool_or(s.line_no IS NOT NULL AND (l.may_move OR s.line_no = l.line)) AS ok
  FROM loc l LEFT JOIN sq s ON s.repo_id = l.repo_id AND s.path = l.path AND s.line LIKE l.pat ESCAPE '\\' GROUP BY ALL)
 SELECT claim_id, count(*) AS locations, count(*) FILTER (WHERE ok) AS kept FROM ok GROUP BY 1 HAVING count(*) FILTER (WHERE ok) >= 2""")
def located_claims(spark, sf_dir):
    """Claims of the first snapshot of which at least two locations still hold in the second."""
    old, _, after = both_findings(spark, sf_dir)
    named = F.substring(F.sha2(F.concat_ws("|", "repo_id", "rule_id", tx.squash(F.col("evidence"))), 256), 1, 16)
    loc = stored(old.select(named.alias("claim_id"), "repo_id", "path", "line", F.lit(None).cast("int").alias("line_end"), "evidence",
                            F.lit(None).cast("string").alias("indexed_sha256")))
    claims = loc.groupBy("claim_id").agg(F.count("*").alias("locations"))
    return K.filter_locations(claims, loc, after, keep_counts=True).select("claim_id", "locations", "kept")
