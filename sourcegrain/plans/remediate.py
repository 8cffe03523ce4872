"""Remediation queries over the findings of the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import remediate as L
from sourcegrain.operators import rules as R
from sourcegrain.plans import inputs
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import CODE_CLAIMS, q, rx
from sourcegrain.session import stored
from sourcegrain.sources.corpus import explode_lines, table

_FINDINGS = """fnd AS (SELECT repo_id, 'security' AS category, path, line_no AS line, rule_id, family, severity, title, CASE WHEN line_no % 11 = 0 THEN 'stale' ELSE 'verified' END AS status,
 row_number() OVER (PARTITION BY repo_id ORDER BY path, line_no, rule_order) AS number, concat(repo_id, ':', path, ':', line_no, ':', rule_id) AS proposal_id FROM claims)"""
_BASE = CODE_CLAIMS + ", " + _FINDINGS


def findings(spark, sf_dir):
    from sourcegrain.functions.ranking import number_rows
    lines = explode_lines(inputs.code(spark, sf_dir), "repo_id", "path", "kind", "language")
    c = R.scan(lines)
    c = number_rows(c, [F.col("path").asc(), F.col("line_no").asc(), F.col("rule_order").asc()], "number", per="repo_id")
    pid = F.concat_ws(":", "repo_id", "path", F.col("line_no").cast("string"), "rule_id")
    return c.select("repo_id", F.lit("security").alias("category"), "path", F.col("line_no").alias("line"), F.col("line_no").alias("finding_line"), "rule_id", "family",
                    "severity", "title", F.when(F.col("line_no") % 11 == 0, "stale").otherwise("verified").alias("status"), "number", pid.alias("proposal_id"))


_GOALS = ["fix the sql injection", "fix finding #7", "fix high severity issues", "fix all", "remove duplicates", "security problems please", "critical ones"]


@query("goal_scope", "L1", _BASE + f""", gl AS (SELECT DISTINCT repo_id, g FROM fnd, (SELECT unnest(range(0, 7)) AS g) t)
 SELECT g AS goal_id, f.repo_id, f.number, f.rule_id FROM gl JOIN fnd f USING (repo_id) WHERE CASE g WHEN 0 THEN f.rule_id = 'sql-injection' WHEN 1 THEN f.number = 7
 WHEN 2 THEN f.severity IN ('high', 'critical') WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true ELSE f.severity IN ('high', 'critical') END""")
def goal_scope(spark, sf_dir):
    f = stored(findings(spark, sf_dir))
    goals = f.select("repo_id").distinct().select("repo_id", F.posexplode(F.array(*[F.lit(g) for g in _GOALS])).alias("goal_id", "goal"))
    return L.scope(goals, f).select("goal_id", "repo_id", "number", "rule_id")


_HAS = "(" + ", ".join(q(r) for r in L.STRATEGIES) + ")"


@query("scope_partition", "L2", _BASE + f""" SELECT repo_id, rule_id, CASE WHEN status = 'verified' AND rule_id IN {_HAS} THEN 'rewrite' ELSE 'manual' END AS plan,
 CASE WHEN status <> 'verified' THEN 'finding is STALE' WHEN rule_id IN {_HAS} THEN NULL {' '.join(f"WHEN rule_id = {q(k)} THEN {q(v)}" for k, v in L.MANUAL_REASONS.items())}
 ELSE {q(L.NO_REWRITE)} END AS reason, count(*) AS n FROM fnd GROUP BY ALL""")
def scope_partition(spark, sf_dir):
    return L.partition_scope(findings(spark, sf_dir)).groupBy("repo_id", "rule_id", "plan", "reason").agg(F.count("*").alias("n"))


def _proposals(spark, sf_dir):
    files = inputs.code(spark, sf_dir)
    return L.proposals(L.partition_scope(findings(spark, sf_dir)), files), files


_ENV = (r"upper(array_to_string(regexp_extract_all(regexp_replace(replace({}, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\d+'), '_'))")
_SN = r"""(?i)\b(""" + R.SECRET_NAME + r""")(["']?\s*[:=]\s*)(?:"[^'"`\s]{6,}"|'[^'"`\s]{6,}'|`[^'"`\s]{6,}`)"""
_NAME = _ENV.format(f"regexp_extract(s, {q(_SN)}, 1)")
_TARGET = f"CASE WHEN language = 'python' THEN concat('os.environ[\"', {_NAME}, '\"]') ELSE concat('process.env.', {_NAME}) END"
PROPOSALS = f"""pr0 AS (SELECT f.*, c.language, c.kind, c.lines, c.lines[f.line] AS s FROM fnd f JOIN code c USING (repo_id, path) WHERE f.status = 'verified' AND f.rule_id IN {_HAS}),
 pr1 AS (SELECT *, CASE rule_id
  WHEN 'hardcoded-secret' THEN CASE WHEN kind = 'source' AND {rx(_SN, 's')} AND NOT regexp_matches(path, '^(frontend|web)/') THEN
    [replace(regexp_replace(s, {q(_SN)}, concat('\\1\\2', chr(1))), chr(1), {_TARGET})] END
  WHEN 'known-key-format' THEN NULL
  WHEN 'insecure-http' THEN [regexp_replace(s, '([''"`])http://', '\\1https://')]
  WHEN 'insecure-cors' THEN [replace(s, 'origin: ''*''', {q('origin: ' + L.CORS_LIST)})]
  WHEN 'exposed-env' THEN [replace(s, 'res.json(process.env)', 'res.json({{ nodeEnv: process.env.NODE_ENV || ''development'' }})')]
  WHEN 'dom-xss' THEN [replace(s, '.innerHTML', '.textContent')]
  WHEN 'jwt-no-verify' THEN NULL
  WHEN 'prompt-injection' THEN [{q('// ' + L.NEUTRAL_NOTE)}]
  WHEN 'tls-disabled' THEN [replace(replace(s, 'rejectUnauthorized: false', 'rejectUnauthorized: true'), 'verify=False', 'verify=True')]
  WHEN 'sql-injection' THEN ['  const sql = ''SELECT * FROM t WHERE id = ?'';', '  return pool.query(sql, [id]);'] END AS after FROM pr0)"""


@query("rewrite_proposals", "L3 L4 L5 L6 L7 L8 L9 L10 L11", _BASE + ", " + PROPOSALS + """ SELECT proposal_id, rule_id, array_to_string(lines[line:line + len(after) - 1], chr(10)) AS before_text,
 array_to_string(after, chr(10)) AS after_text FROM pr1 WHERE after IS NOT NULL""")
def rewrite_proposals(spark, sf_dir):
    p, _ = _proposals(spark, sf_dir)
    return p.where("after IS NOT NULL").select("proposal_id", "rule_id", F.array_join("before", "\n").alias("before_text"), F.array_join("after", "\n").alias("after_text"))


def reviewed(spark, sf_dir):
    p, files = _proposals(spark, sf_dir)
    return L.reject_overlaps(stored(L.review(stored(p), files))), files


@query("safety_review", "L12 L13", _BASE + ", " + PROPOSALS + """ SELECT rule_id, CASE WHEN after = lines[line:line + len(after) - 1] THEN 'no change' END AS rejection, count(*) AS n
 FROM pr1 WHERE after IS NOT NULL GROUP BY ALL""")
def safety_review(spark, sf_dir):
    return reviewed(spark, sf_dir)[0].groupBy("rule_id", "rejection").agg(F.count("*").alias("n"))


def rescanned(spark, sf_dir):
    r, files = reviewed(spark, sf_dir)
    accepted = r.where("rejection IS NULL").join(files.select("repo_id", "path", "kind", "language"), ["repo_id", "path"])
    hits = R.scan_lines(explode_lines(files, "repo_id", "path", "kind", "language"))
    return L.verify_by_rescan(stored(accepted), stored(hits)), files


@query("verify_by_rescan", "L14", _BASE + ", " + PROPOSALS + """ SELECT rule_id, 'verified' AS status, count(*) AS n FROM pr1 WHERE after IS NOT NULL GROUP BY ALL""")
def verify_by_rescan(spark, sf_dir):
    return rescanned(spark, sf_dir)[0].groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query("apply_patches", "L15", _BASE + ", " + PROPOSALS + """, ed AS (SELECT repo_id, path, line + unnest(range(0, len(after))) AS line_no, unnest(after) AS new FROM pr1 WHERE after IS NOT NULL)
 SELECT l.repo_id, l.path, sha256(string_agg(coalesce(e.new, l.line), chr(10) ORDER BY l.line_no)) AS sha256, count(e.new) AS changed FROM code_lines l LEFT JOIN ed e USING (repo_id, path, line_no)
 GROUP BY 1, 2""")
def apply_patches(spark, sf_dir):
    v, files = rescanned(spark, sf_dir)
    out = L.apply_patches(explode_lines(files), v.where("status = 'verified'"))
    # one file per group: its lines are bounded by the file
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return out.groupBy("repo_id", "path").agg(F.sha2(text, 256).alias("sha256"), F.count_if("changed").alias("changed"))


@query("remediation_metrics", "L16", _BASE + ", " + PROPOSALS + """ SELECT repo_id, CASE WHEN rule_id = 'sql-injection' THEN 'parameterized-query' WHEN rule_id = 'insecure-http' THEN 'http-to-https'
 WHEN rule_id = 'hardcoded-secret' THEN 'secret-to-env' WHEN rule_id = 'insecure-cors' THEN 'cors-allow-list' WHEN rule_id = 'exposed-env' THEN 'env-allow-list'
 WHEN rule_id = 'dom-xss' THEN 'innerhtml-to-textcontent' WHEN rule_id = 'prompt-injection' THEN 'remove-ai-instruction' ELSE 'enable-tls-verification' END AS strategy,
 count(*) AS verified FROM pr1 WHERE after IS NOT NULL GROUP BY ALL""")
def remediation_metrics(spark, sf_dir):
    v, _ = rescanned(spark, sf_dir)
    return v.where("status = 'verified'").groupBy("repo_id", "strategy").agg(F.count("*").alias("verified"))
