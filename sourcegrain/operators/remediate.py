"""Line rewrites as a table job: scope, proposals, safety review, re-scan, apply."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.identifiers import split_identifier
from sourcegrain.functions.stages import hold
from sourcegrain.operators import rules as R
from sourcegrain.operators.routing import SCANNER_KEYWORDS

# ---- fixed values: goal words, strategies, reasons, limits ----
RULE_WORDS = {
    "sql-injection": ["sql"], "dom-xss": ["xss", "innerhtml", "cross-site"], "unsafe-eval": ["eval"], "insecure-cors": ["cors"],
    "jwt-no-verify": ["jwt", "signature"], "insecure-http": ["http ", "https", "plain http", "unencrypted"], "prompt-injection": ["prompt"],
    "exposed-env": ["env var", "environment variable", "process.env", "debug endpoint"], "weak-hash": ["md5", "sha1", "weak hash"],
    "token-localstorage": ["localstorage"], "hardcoded-secret": ["secret", "api key", "apikey", "credential", "password", "hardcoded"],
    "known-key-format": ["secret", "api key", "apikey", "credential", "hardcoded"],
}
ALL_WORDS = ["everything", "all issues", "all findings", "all problems", "every issue", "all of them", "fix all"]
SECURITY_WORDS = ["security", "vulnerab", "insecure", "unsafe"]
DUPLICATE_WORDS = ["duplicate", "duplicat", "clone", "copy-paste", "copies"]
SEVERITIES = ["critical", "high", "medium", "low"]
STRATEGIES = {
    "hardcoded-secret": "secret-to-env", "known-key-format": "secret-to-env", "insecure-http": "http-to-https", "insecure-cors": "cors-allow-list",
    "exposed-env": "env-allow-list", "dom-xss": "innerhtml-to-textcontent", "jwt-no-verify": "jwt-verify", "sql-injection": "parameterized-query",
    "prompt-injection": "remove-ai-instruction", "tls-disabled": "enable-tls-verification",
}
MANUAL_REASONS = {
    "unsafe-eval": "eval needs a designed replacement", "unsafe-eval-py": "eval/exec needs explicit parsing",
    "weak-hash": "stored hashes need a migration", "token-localstorage": "cookies change server and client",
    "private-key": "delete and rotate the key", "command-injection": "needs an input validation design",
    "command-injection-py": "needs an input validation design", "path-traversal": "needs a fixed base folder",
    "mass-assignment": "needs an allow-list of fields", "insecure-random": "depends on how the value is used",
    "debug-enabled": "belongs in environment configuration",
}
DUPLICATE_REASON = "duplicate refactors span several files"
NO_REWRITE = "no safe automatic rewrite exists for this rule"
BROWSER_DIRS = ["frontend", "public", "client", "web", "static", "www", "browser"]
CORS_LIST = "(process.env.CORS_ORIGINS || '').split(',').filter(Boolean)"
DANGEROUS = r"(?<![\w.$])eval\s*\(|\bnew\s+Function\s*\(|child_process|\bexec(?:Sync)?\s*\(|os\.system"
NEUTRAL_NOTE = "NOTE: text addressed to AI tools was removed here."
COMMENT = r"^(\s*)(//+|#+|\*|<!--|--)\s?"
SQL_CONCAT = r"""(["'])([^"'`\n]*?)'\1\s*\+\s*([A-Za-z_$][\w$.]*)\s*\+\s*(["'])'([^"'`\n]*)\4"""
MAX_SPAN, MAX_DISTANCE, MAX_TEXT = 6, 4, 4000
# ---- end of fixed values ----


def _any(text: Column, words: list[str]) -> Column:
    test = text.contains(words[0])
    for w in words[1:]:
        test = test | text.contains(w)
    return test


def _picked(text: Column, table: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(_any(text, words), F.lit(k)) for k, words in table.items()]))


def scope(goals: DataFrame, findings: DataFrame) -> DataFrame:
    """Numbered findings that each goal (goal_id, repo_id, goal) addresses: an equi-join on the repository."""
    low = F.concat(F.lit(" "), F.lower("goal"), F.lit(" "))
    g = hold(goals, low=low)
    numbers = F.transform(F.regexp_extract_all("low", F.lit(r"(?:#|\bfindings?\s+|\bnumbers?\s+|\b)(\d{1,3})\b"), F.lit(1)), lambda n: n.cast("long"))
    families = F.flatten(F.transform(_picked(F.col("low"), SCANNER_KEYWORDS), lambda k: F.element_at(F.create_map(
        *[x for key, fams in R.SCANNER_FAMILIES.items() for x in (F.lit(key), F.array(*[F.lit(f) for f in fams]))]), k)))
    severities = F.array_compact(F.array(*[F.when(F.col("low").rlike(rf"\b{s}\b"), F.lit(s)) for s in SEVERITIES]))
    severe = F.array_contains("sev0", "high") | F.col("low").contains("severe") | F.col("low").contains("critical")
    none = F.array().cast("array<string>")
    g = hold(g, numbers=numbers, rules=_picked(F.col("low"), RULE_WORDS), sev0=severities)
    g = hold(g, families=F.when(F.size("rules") > 0, none).otherwise(families),
             severities=F.when(severe, F.array_union("sev0", F.array(F.lit("critical"), F.lit("high")))).otherwise(F.col("sev0")),
             duplicates=_any(F.col("low"), DUPLICATE_WORDS))
    g = hold(g, security=_any(F.col("low"), SECURITY_WORDS) | (F.size("families") > 0) | (F.size("rules") > 0))
    g = hold(g, everything=_any(F.col("low"), ALL_WORDS) | ~(F.col("security") | F.col("duplicates") | (F.size("severities") > 0)))
    totals = findings.groupBy("repo_id").agg(F.count("*").alias("_total"))
    g = g.join(totals, "repo_id").withColumn("numbers", F.filter("numbers", lambda n: (n >= 1) & (n <= F.col("_total"))))
    rows = g.drop("low", "sev0", "goal", "_total").join(findings, "repo_id")
    dup = F.col("duplicates") | (F.col("everything") & ~F.col("security"))
    sec = (((F.size("rules") == 0) | F.array_contains("rules", F.col("rule_id"))) & ((F.size("families") == 0) | F.array_contains("families", F.col("family")))
           & ((F.size("severities") == 0) | F.array_contains("severities", F.col("severity"))) & (F.col("security") | (F.size("severities") > 0) | F.col("everything")))
    chosen = F.when(F.size("numbers") > 0, F.array_contains("numbers", F.col("number").cast("long"))).when(F.col("category") == "duplicate", dup).otherwise(sec)
    return rows.where(chosen).drop("numbers", "rules", "families", "severities", "duplicates", "security", "everything")


def partition_scope(findings: DataFrame) -> DataFrame:
    """Add ``plan`` (rewrite or manual) and the reason of manual ones."""
    known = F.create_map(*[F.lit(x) for kv in MANUAL_REASONS.items() for x in kv])
    has = F.col("rule_id").isin(list(STRATEGIES))
    reason = (F.when(F.col("status") != "verified", F.concat(F.lit("finding is "), F.upper("status")))
              .when(F.col("category") == "duplicate", DUPLICATE_REASON).when(has, F.lit(None))
              .otherwise(F.coalesce(F.try_element_at(known, F.col("rule_id")), F.lit(NO_REWRITE))))
    return findings.withColumn("reason", reason).withColumn("plan", F.when(F.col("reason").isNull(), "rewrite").otherwise("manual"))


def env_name(name: Column) -> Column:
    joined = F.upper(F.array_join(split_identifier(name), "_"))
    return F.when(joined == "", "SECRET_VALUE").otherwise(joined)


def _first(line: Column, pattern: str, *middle, flags: str = "") -> Column:
    """Replace the first match: ``middle`` are literals or group numbers of the pattern; null without a match."""
    whole = f"(?s){flags}^(.*?)(?:{pattern})(.*)$"
    groups = re.compile(whole.replace("(?s)", "").replace("(?i)", "")).groups
    pieces = [F.regexp_extract(line, whole, m + 1) if isinstance(m, int) else (m if isinstance(m, Column) else F.lit(m)) for m in middle]
    return F.when(line.rlike(whole), F.concat(F.regexp_extract(line, whole, 1), *pieces, F.regexp_extract(line, whole, groups)))


_SECRET = r"""\b(""" + R.SECRET_NAME + r""")(["']?\s*[:=]\s*)(['"`])([^'"`\s]{6,})\4"""


def proposals(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Rewrites (before, after as arrays of lines) for findings planned as rewrites; null after means none."""
    src = files.select("repo_id", "path", "kind", "language", "lines")
    df = findings.where("plan = 'rewrite'").join(src, ["repo_id", "path"])
    df = hold(df, s=F.try_element_at("lines", F.col("line")), body=tx.join_lines(F.col("lines")))
    s, body = F.col("s"), F.col("body")
    js = F.col("language").isin(list(R.JS))
    browser = F.exists(tx.dir_parts(F.lower("path")), lambda d: d.isin(BROWSER_DIRS))
    name = env_name(R.secret_name(s))
    target = F.when(js & ~browser, F.concat(F.lit("process.env."), name)).when(
        (F.col("language") == "python") & body.rlike(r"(?m)^\s*(?:import os\b|from os import)"), F.concat(F.lit('os.environ["'), name, F.lit('"]')))
    secret = F.when(F.col("kind") == "source", _first(s, _SECRET, 1, 2, target, flags="(?i)"))
    http = _first(s, R.INSECURE_HTTP.replace("""['"`]http://""", """(['"`])http://""").replace("""[^'"`\\s]+""", """([^'"`\\s]+)"""), 1, "https://", 2)
    cors = F.when(js, F.coalesce(_first(s, r"""origin\s*:\s*(['"`])\*\2""", f"origin: {CORS_LIST}"), _first(s, r"\bcors\(\s*\)", "cors({ origin: " + CORS_LIST + " })")))
    env = F.coalesce(_first(s, r"(res\.(?:json|send)\s*\(\s*)process\.env(\s*\))", 1, "{ nodeEnv: process.env.NODE_ENV || 'development' }", 2),
                     _first(s, r"console\.log\s*\(\s*process\.env\s*\)", "console.log('Environment variables loaded:', Object.keys(process.env).length)"))
    xss = _first(s, r"\.innerHTML(\s*=)", ".textContent", 1)
    key = F.coalesce(F.nullif(F.regexp_extract(body, r"\bjwt\.verify\s*\(\s*[^,()]+,\s*([A-Za-z_$][\w$.]*)", 1), F.lit("")),
                     F.nullif(F.regexp_extract(body, r"(?i)\b(?:const|let|var)\s+([A-Za-z_$]*SECRET[\w$]*)\s*=", 1), F.lit("")))
    jwt = F.when(js & key.isNotNull(), _first(s, r"\bjwt\.decode\s*\(\s*([^,()]+?)\s*\)", "jwt.verify(", 1, ", ", key, ")"))
    closing = F.when(F.regexp_extract(s, COMMENT, 2) == "<!--", " -->").otherwise("")
    prompt = F.when(s.rlike(COMMENT), F.concat(F.regexp_extract(s, COMMENT, 1), F.regexp_extract(s, COMMENT, 2), F.lit(" " + NEUTRAL_NOTE), closing)).otherwise(
        F.regexp_replace(s, R.PROMPT_INJECTION, "[instruction for AI tools removed]"))
    tls = F.coalesce(_first(s, r"(rejectUnauthorized\s*:\s*)false", 1, "true"), _first(s, r"(\bverify\s*=\s*)False", 1, "True"),
                     _first(s, r"(InsecureSkipVerify:\s*)true", 1, "false"))
    # SQL: a placeholder in the literal and the value bound where the query runs, on this or a near line
    mark = F.when(body.rlike(r"""require\(\s*['"]pg['"]\s*\)|from\s+['"]pg['"]"""), "$1").otherwise("?")
    g = lambda n: F.regexp_extract(s, SQL_CONCAT, n)
    literal = F.concat(F.lit("'"), g(2), mark, g(5), F.lit("'"))
    shifted = SQL_CONCAT.replace(r"\1", r"\2").replace(r"\4", r"\5")
    head, tail = F.regexp_extract(s, f"^(.*?)(?:{shifted})(.*)$", 1), F.regexp_extract(s, f"^(.*?)(?:{shifted})(.*)$", 7)
    value = F.concat(F.lit("["), g(3), F.lit("]"))
    variable = F.regexp_extract(s, r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", 1)
    call = F.concat(F.lit(r"\.(query|execute)\(\s*\Q"), variable, F.lit(r"\E\s*\)"))
    near = F.slice("lines", F.col("line") + 1, F.lit(4))
    at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.size(near)), lambda i: F.rlike(F.element_at(near, i), call)), F.lit(1))
    bound = F.regexp_replace(F.element_at(near, at), call, F.concat(F.lit(".$1("), variable, F.lit(", "), value, F.lit(")")))
    is_sql = js & s.rlike(SQL_CONCAT)
    sql = (F.when(is_sql & head.rlike(r"\.(query|execute)\(\s*$"), F.array(F.concat(head, literal, F.lit(", "), value, tail)))
           .when(is_sql & (variable != "") & (F.size(near) > 0) & at.isNotNull(), F.concat(
               F.array(F.concat(head, literal, tail)), F.slice(near, F.lit(1), at - 1), F.array(bound))))
    one = {"hardcoded-secret": secret, "known-key-format": secret, "insecure-http": http, "insecure-cors": cors, "exposed-env": env, "dom-xss": xss,
           "jwt-no-verify": jwt, "prompt-injection": prompt, "tls-disabled": tls}
    after = F.when(F.col("rule_id") == "sql-injection", sql)
    for rule, new in one.items():
        after = after.when(F.col("rule_id") == rule, F.when(new.isNotNull(), F.array(new)))
    strategy = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), F.col("rule_id"))
    df = hold(df, after=after)
    return df.withColumn("before", F.when(F.col("after").isNotNull(), F.slice("lines", F.col("line"), F.size("after")))).withColumn(
        "strategy", strategy).drop("s", "body", "lines", "kind", "language")


def review(props: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``rejection``: the first failing safety check, null when the patch may be verified."""
    df = props.where("after IS NOT NULL").join(files.select("repo_id", "path", F.col("lines").alias("_l")), ["repo_id", "path"], "left")
    n = F.size("before")
    touched = F.filter(F.transform("before", lambda b, i: F.when(b != F.get("after", i), F.col("line") + i)), lambda x: x.isNotNull())
    df = hold(df, _t=touched, new=F.array_join("after", "\n"), old=F.array_join("before", "\n"))
    far = F.exists("_t", lambda x: F.abs(x - F.col("finding_line")) > MAX_DISTANCE)
    new, old = F.col("new"), F.col("old")
    secret = R.SECRET_ASSIGNMENT
    reason = (F.when(F.col("_l").isNull(), "file missing")
              .when((F.col("line") + n - 1 > F.size("_l")) | (F.slice("_l", F.col("line"), F.greatest(n, F.lit(1))) != F.col("before")), "source mismatch")
              .when(F.size("after") != n, "line count").when(n > MAX_SPAN, "too many lines").when(F.size("_t") == 0, "no change")
              .when(~F.array_contains("_t", F.col("finding_line")) | far, "out of scope")
              .when(F.exists("after", lambda a: a.rlike("[\\n\\r]")), "line break").when(new.contains("[REDACTED"), "placeholder")
              .when(new.rlike(R.KNOWN_KEY) | (new.rlike(secret) & ~old.rlike(secret)), "new credential")
              .when(new.rlike(DANGEROUS) & ~old.rlike(DANGEROUS), "new execution").when(F.length(new) > MAX_TEXT, "too large"))
    return df.withColumn("rejection", reason).drop("_l", "_t", "new", "old")


def reject_overlaps(reviewed: DataFrame) -> DataFrame:
    """Earlier proposals claim their lines; a later one that shares a line with an accepted one is rejected.

    A sweep over the lines of a file cuts its acceptable proposals into chains of overlapping ones. Most chains hold one proposal
    and are settled there; only in longer ones the order by number matters, so only they are folded. Ties of number go by proposal_id.
    """
    last = F.col("line") + F.greatest(F.size("after"), F.lit(1)) - 1
    able = reviewed.where("rejection IS NULL").select("repo_id", "path", "number", "proposal_id", "line", last.alias("last"))
    along = Window.partitionBy("repo_id", "path").orderBy("line", "last", "proposal_id")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    able = able.withColumn("_new", (reach.isNull() | (reach < F.col("line"))).cast("int")).withColumn("chain", F.sum("_new").over(along))
    item = F.struct("number", "proposal_id", "line", "last")
    chains = able.groupBy("repo_id", "path", "chain").agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") > 1)
    start = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast("array<string>").alias("lost"))

    def step(acc: Column, x: Column) -> Column:
        span = F.sequence(x["line"], x["last"]).cast("array<int>")
        hit = F.arrays_overlap(acc["claimed"], span)
        return F.struct(F.when(hit, acc["claimed"]).otherwise(F.concat(acc["claimed"], span)).alias("claimed"),
                        F.when(hit, F.array_append(acc["lost"], x["proposal_id"])).otherwise(acc["lost"]).alias("lost"))
    lost = chains.select(F.explode(F.aggregate("items", start, step, lambda a: a["lost"])).alias("proposal_id")).withColumn("_lost", F.lit(True))
    return reviewed.join(lost, "proposal_id", "left").withColumn("rejection", F.when(F.col("_lost"), "overlap").otherwise(F.col("rejection"))).drop("_lost")


def verify_by_rescan(accepted: DataFrame, hits: DataFrame) -> DataFrame:
    """Re-scan the patched lines: the target rule must be gone and nothing new may appear in the file.

    Rules look at single lines, so hits of the other lines stay as they are and cancel out: a rule and evidence is new in the file
    where the patched lines hold it more often than the same lines did before. Only hits on the touched lines are joined,
    by file and line; ``hits`` is the whole scan, so a hit behind a limit never counts as introduced.
    """
    patched = accepted.select("proposal_id", "repo_id", "path", "kind", "language", F.posexplode("after").alias("i", "text"), F.col("line").alias("at"))
    patched = patched.select("proposal_id", "repo_id", "path", "kind", "language", (F.col("at") + F.col("i")).alias("line_no"), F.col("text").alias("line"))
    found = ["proposal_id", "rule_id", "evidence"]
    fresh = R.scan_lines(patched).select(*found, F.lit(1).alias("more"))
    gone = patched.select("proposal_id", "repo_id", "path", "line_no").join(hits.select("repo_id", "path", "line_no", "rule_id", "evidence"), ["repo_id", "path", "line_no"])
    delta = fresh.unionByName(gone.select(*found, F.lit(-1).alias("more"))).groupBy(*found).agg(F.sum("more").alias("more"), F.max("more").alias("any"))
    told = delta.groupBy("proposal_id").agg(F.array_sort(F.collect_set(F.when(F.col("more") > 0, F.col("rule_id")))).alias("introduced"),
                                            F.collect_set(F.when(F.col("any") > 0, F.col("rule_id"))).alias("present"))
    out = accepted.join(told, "proposal_id", "left")
    why = F.when(F.array_contains("present", F.col("rule_id")), "rule still matches").when(
        F.size("introduced") > 0, F.concat(F.lit("introduces "), F.array_join("introduced", ", ")))
    return out.withColumn("rejection", why).withColumn("status", F.when(F.col("rejection").isNull(), "verified").otherwise("rejected")).drop("present", "introduced")


def apply_patches(lines: DataFrame, verified: DataFrame) -> DataFrame:
    """New snapshot of (repo_id, path, line_no, line); ``conflict`` marks lines that are not what the patch expects."""
    edits = verified.select("repo_id", "path", F.col("line").alias("at"), F.posexplode(F.arrays_zip("before", "after")).alias("i", "e"))
    edits = edits.select("repo_id", "path", (F.col("at") + F.col("i")).alias("line_no"), F.col("e.before").alias("expected"), F.col("e.after").alias("new"))
    edits = edits.dropDuplicates(["repo_id", "path", "line_no"])
    joined = lines.join(edits, ["repo_id", "path", "line_no"], "left")
    conflict = F.coalesce(F.col("expected") != F.col("line"), F.lit(False))
    return joined.select("repo_id", "path", "line_no", F.when(conflict, F.col("line")).otherwise(F.coalesce("new", "line")).alias("line"), conflict.alias("conflict"),
                         (F.col("new").isNotNull() & ~conflict).alias("changed"))
