"""Rule-scan queries with RE2 forms of every pattern for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.functions import redact as rd
from sourcegrain.functions import text as tx
from sourcegrain.operators import rules as R
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, CODE_LINES, DOC_LINES, DOCS, ctes
from sourcegrain.plans.registry import query
from sourcegrain.sources.corpus import explode_lines, table


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, col: str = "line") -> str:
    return f"regexp_matches({col}, {q(pattern)})"


_JS = "language IN ('javascript', 'typescript', 'vue', 'svelte')"
_SECRET = (r"(?i)\b(" + R.SECRET_NAME + r""")["']?\s*[:=]\s*(?:"([^'"`\s]{6,})"|'([^'"`\s]{6,})'|`([^'"`\s]{6,})`)""")
_SNAME = f"regexp_extract(line, {q(_SECRET)}, 1)"
_SVALUE = "concat(" + ", ".join(f"regexp_extract(line, {q(_SECRET)}, {g})" for g in (2, 3, 4)) + ")"
_VALID = f"""({_SVALUE} <> '' AND NOT {rx(R.PLACEHOLDER_VALUE, _SVALUE)} AND NOT {rx(R.NON_SECRET_NAME, _SNAME)}
 AND NOT {rx(R.VERSION_VALUE, _SVALUE)}
 AND NOT ({rx('^[^' + chr(92) + 'w' + chr(92) + 's]', _SVALUE)} AND length({_SVALUE}) >= 3
  AND {_SVALUE}[1] = {_SVALUE}[2] AND {_SVALUE}[1] = {_SVALUE}[-1])
 AND {rx(r'[\p{Ll}\p{Nd}]', _SVALUE)} AND ({rx(r'[\p{Nd}_./+=-]', _SVALUE)} OR length({_SVALUE}) >= 16))"""
_DYNAMIC = "(" + " OR ".join([
    rx(R.CONCAT), rx(R.TEMPLATE), rx(r"""\bf'.*\{[^}]+\}.*'"""), rx(r'''\bf".*\{[^}]+\}.*"'''),
    rx(R.PY_FORMAT)]) + ")"
_HTTP = (f"(len(list_filter(regexp_extract_all(line, {q(chr(91) + chr(39) + chr(34) + '`]http://[^' + chr(39) + chr(34) + '`' + chr(92) + 's]+')}), "
         f"lambda u: NOT {rx(r'^.http://(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|www\.w3\.org|schemas\.|json-schema\.org|example\.(com|org|net))', 'u')})) > 0)")
_XSS = "(" + " OR ".join([
    rx(r"\.outerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML|insertAdjacentHTML\s*\("),
    f"({rx(r'\.innerHTML\s*=')} AND NOT {rx(r'''\.innerHTML\s*=\s*['"][^'"$]*['"]\s*;?\s*$''')})"]) + ")"
# DuckDB predicate per rule: lookaround and back-references are written out.
PREDICATES = {
    "hardcoded-secret": _VALID,
    "known-key-format": rx(R.KNOWN_KEY),
    "private-key": rx(R.PRIVATE_KEY),
    "sql-injection": f"({rx(R.SQL_KEYWORDS)} AND {_DYNAMIC})",
    "command-injection": (
        "((" + rx(r"(child_process|childProcess|cp)\.(exec|execSync|spawn|spawnSync)\s*\(") + " OR "
        + rx(r"(^|[^\w.$])(exec|execSync)\s*\(") + f") AND ({_DYNAMIC} OR line LIKE '%${{%'))"),
    "command-injection-py": f"({rx(R.PY_SHELL_TRUE)} OR ({rx(R.PY_SHELL)} AND ({_DYNAMIC} OR line LIKE '%+%')))",
    "unsafe-eval": rx(r"(^|[^\w.$])eval\s*\(|\bnew\s+Function\s*\(|\bset(?:Timeout|Interval)\s*\(\s*['" + '"' + "`]"),
    "unsafe-eval-py": rx(r"(^|[^\w.])(eval|exec)\s*\("),
    "insecure-cors": rx(R.INSECURE_CORS),
    "jwt-no-verify": rx(R.JWT_JS),
    "jwt-no-verify-py": rx(R.JWT_PY),
    "exposed-env": rx(R.EXPOSED_ENV),
    "path-traversal": rx(R.PATH_TRAVERSAL),
    "insecure-http": _HTTP,
    "weak-hash": rx(R.WEAK_HASH),
    "insecure-random": rx(R.INSECURE_RANDOM),
    "dom-xss": _XSS,
    "token-localstorage": rx(R.TOKEN_STORAGE),
    "tls-disabled": rx(R.TLS_DISABLED),
    "debug-enabled": rx(R.DEBUG_ENABLED),
    "mass-assignment": rx(R.MASS_ASSIGNMENT),
    "prompt-injection": rx(R.PROMPT_INJECTION),
}
_STRIPPED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_HASH_LANGS = ", ".join(q(x) for x in R.HASH_COMMENT_LANGUAGES)
COMMENT = (f"(regexp_matches({_STRIPPED}, '^(//|/\\*|\\*|<!--)') OR ({_STRIPPED} LIKE '#%' AND language IN ({_HASH_LANGS}))"
           f" OR ({_STRIPPED} LIKE '--%' AND language = 'sql'))")
_TITLE = f"""CASE WHEN lower({_SNAME}) LIKE '%jwt%' THEN 'Hardcoded JWT secret'
 WHEN lower({_SNAME}) LIKE '%api%' AND lower({_SNAME}) LIKE '%key%' THEN 'Hardcoded API key'
 WHEN lower({_SNAME}) LIKE '%pass%' OR lower({_SNAME}) LIKE '%pwd%' THEN 'Hardcoded password'
 WHEN lower({_SNAME}) LIKE '%private%' THEN 'Hardcoded private key'
 WHEN lower({_SNAME}) LIKE '%access%' THEN 'Hardcoded access key'
 WHEN lower({_SNAME}) LIKE '%token%' THEN 'Hardcoded token' ELSE 'Hardcoded secret' END"""


def _masked(value: str) -> str:
    return (f"replace({_STRIPPED}, {value}, CASE WHEN length({value}) > 4 THEN concat(substr({value}, 1, 4), "
            f"'[REDACTED]') ELSE '[REDACTED]' END)")


def _rule_sql(rule: R.Rule, source: str) -> str:
    where = [f"kind IN ({', '.join(q(k) for k in rule.kinds)})", "regexp_matches(line, '\\S')",
             PREDICATES[rule.id]]
    if rule.languages:
        where.append(f"language IN ({', '.join(q(k) for k in rule.languages)})")
    if rule.skip_comments:
        where.append(f"NOT {COMMENT}")
    text = _STRIPPED
    if rule.id == "hardcoded-secret":
        text = _masked(_SVALUE)
    elif rule.id == "known-key-format":
        text = _masked(f"regexp_extract(line, {q(R.KNOWN_KEY)}, 1)")
    title = _TITLE if rule.id == "hardcoded-secret" else q(rule.title)
    return (f"SELECT repo_id, path, line_no, {rule.order} AS rule_order, {q(rule.id)} AS rule_id, {q(rule.family)} AS family, "
            f"{q(rule.severity)} AS severity, {title} AS title, CASE WHEN length({text}) <= 220 THEN {text} "
            f"ELSE concat(substr({text}, 1, 217), '…') END AS evidence, {rule.confidence} AS confidence, {q(rule.cwe)} AS cwe "
            f"FROM {source} WHERE " + " AND ".join(where))


def claims_cte(source: str, name: str = "claims", rules=R.RULES, cap: int | None = None) -> str:
    union = "\nUNION ALL\n".join(_rule_sql(r, source) for r in rules)
    if cap is None:
        return f"{name} AS ({union})"
    return (f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, rule_id "
            f"ORDER BY line_no) AS rn FROM ({union})) WHERE rn <= {cap})")


CLAIMS = claims_cte("code_lines")
DOC_CLAIMS = claims_cte("doc_lines", "doc_claims")
CAPPED_CLAIMS = ctes(CODE, CODE_LINES, claims_cte("code_lines", cap=5))
CODE_CLAIMS = ctes(CODE, CODE_LINES, CLAIMS)
_OUT = "repo_id, path, line_no, rule_id, family, severity, title, evidence, round(confidence, 2) AS confidence, cwe"


def _lines(files):
    return explode_lines(files, "repo_id", "path", "kind", "language")


def code_claims(spark, sf_dir, rules=R.RULES):
    return R.scan(_lines(inputs.code(spark, sf_dir)), rules)


@query("rule_scan_capped", "D0b", f"{CAPPED_CLAIMS} SELECT {_OUT} FROM claims")
def rule_scan_capped(spark, sf_dir):
    """The first five hits of a rule in a file, for callers that want a short report."""
    return _shape(R.scan(_lines(inputs.code(spark, sf_dir)), cap=5))


def doc_claims(spark, sf_dir):
    return R.scan(_lines(inputs.docs(spark, sf_dir)))


def _shape(df):
    return df.select("repo_id", "path", "line_no", "rule_id", "family", "severity", "title", "evidence",
                     F.round("confidence", 2).alias("confidence"), "cwe")


@query("rule_scan_code", "D0 D0b D0c", CODE_CLAIMS + f"SELECT {_OUT} FROM claims")
def rule_scan_code(spark, sf_dir):
    return _shape(code_claims(spark, sf_dir))


@query("rule_scan_documents", "D0 D0b D0c D0d D0e D1", ctes(DOCS, DOC_LINES, DOC_CLAIMS)
       + f"SELECT {_OUT} FROM doc_claims")
def rule_scan_documents(spark, sf_dir):
    return _shape(doc_claims(spark, sf_dir))


def _register_rule(number: int, rule: R.Rule) -> None:
    sql = ctes(CODE, CODE_LINES, claims_cte("code_lines", "claims", (rule,))) + f"SELECT {_OUT} FROM claims"

    @query("rule_" + rule.id.replace("-", "_"), f"D{number}", sql)
    def run(spark, sf_dir):
        return _shape(code_claims(spark, sf_dir, (rule,)))


for _number, _rule in enumerate(R.RULES, start=1):
    _register_rule(_number, _rule)


@query("comment_lines", "D0a", ctes(CODE, CODE_LINES) + f"SELECT repo_id, path, count(*) AS comments FROM code_lines "
       f"WHERE {COMMENT} GROUP BY 1, 2")
def comment_lines(spark, sf_dir):
    lines = _lines(inputs.code(spark, sf_dir))
    return (lines.where(R.is_comment(F.col("line"), F.col("language"))).groupBy("repo_id", "path")
            .agg(F.count("*").alias("comments")))


@query("rule_scan_first_claims", "D0b", CODE_CLAIMS + "SELECT repo_id, path, line_no, rule_id FROM claims "
       "ORDER BY repo_id, path, line_no, rule_order LIMIT 200")
def rule_scan_first_claims(spark, sf_dir):
    return R.cap_total(code_claims(spark, sf_dir)).select("repo_id", "path", "line_no", "rule_id")


_INFER = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"lower(title) LIKE {q('%' + w + '%')}" for w in words) + f" THEN {q(f)}"
    for f, words in R.FAMILY_KEYWORDS.items()) + " END"


@query("infer_family", "D0f", CODE_CLAIMS + f"SELECT title, {_INFER} AS family, count(*) AS n FROM claims GROUP BY 1, 2")
def infer_family(spark, sf_dir):
    return (code_claims(spark, sf_dir).groupBy("title", R.infer_family(F.col("title")).alias("family"))
            .agg(F.count("*").alias("n")))


@query("rule_rollup", "D0g", CODE_CLAIMS + """SELECT repo_id, family, rule_id, count(*) AS hits,
 count(DISTINCT path) AS files FROM claims GROUP BY ROLLUP (repo_id, family, rule_id)""")
def rule_rollup(spark, sf_dir):
    return (code_claims(spark, sf_dir).rollup("repo_id", "family", "rule_id")
            .agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files")))


@query("severity_rollup", "D0g", CODE_CLAIMS + """SELECT repo_id, severity, count(*) AS hits,
 count(DISTINCT path) AS files_affected FROM claims GROUP BY 1, 2""")
def severity_rollup(spark, sf_dir):
    return (code_claims(spark, sf_dir).groupBy("repo_id", "severity")
            .agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files_affected")))


_SCANNER = "CASE " + " ".join(f"WHEN family IN ({', '.join(q(f) for f in fams)}) THEN {q(s)}"
                              for s, fams in R.SCANNER_FAMILIES.items()) + " END"


@query("scanner_rollup", "D0g G12", CODE_CLAIMS + f"""SELECT repo_id, {_SCANNER} AS scanner, count(*) AS candidates
 FROM claims GROUP BY 1, 2""")
def scanner_rollup(spark, sf_dir):
    # each family scanned on its own: the union must equal the single pass
    lines = _lines(inputs.code(spark, sf_dir))
    parts = [R.scan(lines, R.rules_of(s)).withColumn("scanner", F.lit(s)) for s in R.SCANNER_FAMILIES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("repo_id", "scanner").agg(F.count("*").alias("candidates"))


@query("risk_ranked_files", "D0h", CODE_CLAIMS + f""", words AS (SELECT repo_id, path,
 sum(len(regexp_extract_all(line, {q(R.RISK_WORDS)})))::BIGINT AS w FROM code_lines WHERE kind = 'source' GROUP BY 1, 2),
 s AS (SELECT w.repo_id, w.path, coalesce(h.n, 0) * 3 + w.w AS score FROM words w LEFT JOIN
 (SELECT repo_id, path, count(*) AS n FROM claims GROUP BY 1, 2) h ON h.repo_id = w.repo_id AND h.path = w.path)
SELECT repo_id, path, score, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path)
 AS rank_no FROM s WHERE score > 0) WHERE rank_no <= 6""")
def risk_ranked_files(spark, sf_dir):
    files = inputs.code(spark, sf_dir)
    return R.risk_ranked_files(files, R.scan(_lines(files)))


_ASSIGN = (r"""(?i)((?:api[_-]?key|secret|passwd|password|token|private[_-]?key|access[_-]?key|client[_-]?secret)"""
           r"""[A-Za-z0-9_]*['"]?\s*[:=]\s*)(?:(")[^'"`\s]{4,}"|(')[^'"`\s]{4,}'|(`)[^'"`\s]{4,}`)""")


def redact_sql(text: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({text}, {q(rd.PRIVATE_KEY_BLOCK)}, '[REDACTED PRIVATE KEY]', 'g'), "
            f"{q(_ASSIGN)}, '\\1\\2\\3\\4[REDACTED]\\2\\3\\4', 'g'), {q(rd.KNOWN_KEYS)}, '[REDACTED]', 'g')")


@query("redact_documents", "D23", f"SELECT doc_id, sha256({redact_sql('text')}) AS redacted_sha, "
       f"{redact_sql('text')} <> text AS changed FROM documents")
def redact_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", rd.redact(F.col("text")).alias("r"))
    return d.select("doc_id", F.sha2("r", 256).alias("redacted_sha"), (F.col("r") != F.col("text")).alias("changed"))


@query("redact_conversations", "D23", f"SELECT conv_id, turn, {redact_sql('text')} AS redacted FROM conversations")
def redact_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rd.redact(F.col("text")).alias("redacted"))


@query("redact_code", "D23", ctes(CODE) + f"SELECT repo_id, path, {redact_sql('content')} AS redacted FROM code")
def redact_code(spark, sf_dir):
    from sourcegrain.sources.corpus import code_files
    return code_files(spark, sf_dir).select("repo_id", "path", rd.redact(F.col("content")).alias("redacted"))


@query("number_lines_export", "D24", ctes(DOCS, DOC_LINES) + """SELECT repo_id, path, sha256(string_agg(
 concat(CASE WHEN line_no < 10 THEN '   ' WHEN line_no < 100 THEN '  ' WHEN line_no < 1000 THEN ' ' ELSE '' END, line_no, ' | ', replace(replace(line,
  '</repository_content>', concat('<', chr(92), '/repository_content>')), '<repository_content>',
  concat('<', chr(92), 'repository_content>'))), chr(10) ORDER BY line_no)) AS rendered_sha FROM doc_lines GROUP BY 1, 2""")
def number_lines_export(spark, sf_dir):
    body = rd.neutralise(rd.number_lines(F.col("lines")))
    return (inputs.docs(spark, sf_dir).where(F.size("lines") > 0)
            .select("repo_id", "path", F.sha2(body, 256).alias("rendered_sha")))
