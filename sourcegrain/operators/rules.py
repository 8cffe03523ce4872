"""Line rules: security and hygiene findings in one pass over the lines.

A rule is a row of text (id, family, severity, ...) plus a boolean column over a line. All rules are
evaluated in one projection, so the lines are read once and never shuffled; only hits are.
Cheap ``contains`` hints stand in front of every pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx

# ---- fixed values: language groups, patterns, rule texts ----
JS = ("javascript", "typescript", "vue", "svelte")
PY = ("python",)
SOURCE = ("source",)
SOURCE_CONFIG = ("source", "config", "manifest")
EVERYTHING = ("source", "config", "manifest", "doc")
HASH_COMMENT_LANGUAGES = ["python", "shell", "yaml", "toml", "ruby", "dockerfile", "makefile", "ini", "dotenv", "r",
                          "elixir", "powershell", "terraform", "properties"]
SECRET_NAME = (r"[A-Za-z0-9_]*(?:api[_-]?key|secret|passwd|password|pwd|token|private[_-]?key|access[_-]?key|"
               r"client[_-]?secret|auth[_-]?key)[A-Za-z0-9_]*")
SECRET_ASSIGNMENT = r"""(?i)\b(""" + SECRET_NAME + r""")["']?\s*[:=]\s*(['"`])([^'"`\s]{6,})\2"""
KNOWN_KEY = (r"(sk-(?:live|proj|test)-[A-Za-z0-9_\-]{16,}|sk-[A-Za-z0-9]{32,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}"
             r"|github_pat_[A-Za-z0-9_]{40,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}"
             r"|sk_live_[0-9a-zA-Z]{20,})")
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----"
PLACEHOLDER_VALUE = (r"(?i)^(?:\$\{|<|\{\{|your|xxx|\*{3,}|changeme|change_me|placeholder|example|dummy|todo|none|null|"
                     r"undefined|process\.env|os\.environ|replace)")
NON_SECRET_NAME = (r"(?i)(url|uri|path|header|field|name|label|type|pattern|regex|prefix|length|message|msg|endpoint|"
                   r"file|dir|column|placeholder|key_name|storage_key|param|query)$")
VERSION_VALUE = r"^[~^<>=v]*\d+(?:\.[\dx*]+)*(?:[-+][\w.]+)?$"
MARKER_VALUE = r"^([^\w\s])\1+.*\1+$"
SQL_KEYWORDS = r"(?i)\b(select\s.+\sfrom|insert\s+into|update\s+\w+\s+set|delete\s+from)\b"
CONCAT = r"""['"]\s*\+\s*[A-Za-z_$(]|[A-Za-z_$)\]]\s*\+\s*['"]"""
TEMPLATE = r"`[^`]*\$\{[^`]*`"
PY_FSTRING = r"""\bf(['"]).*\{[^}]+\}.*\1"""
PY_FORMAT = r"""(['"])\s*%\s*[\(\w]|\.format\("""
JS_EXEC = (r"(?:child_process|childProcess|cp)\.(?:exec|execSync|spawn|spawnSync)\s*\("
           r"|(?<![\w.$])(?:exec|execSync)\s*\(")
PY_SHELL = r"\bos\.(?:system|popen)\s*\("
PY_SHELL_TRUE = r"\bsubprocess\.\w+\([^)]*shell\s*=\s*True"
UNSAFE_EVAL = r"(?<![\w.$])eval\s*\(|\bnew\s+Function\s*\(|\bset(?:Timeout|Interval)\s*\(\s*['\"`]"
UNSAFE_EVAL_PY = r"(?<![\w.])(?:eval|exec)\s*\("
INSECURE_CORS = (r"""(?i)(?:origin\s*:\s*['"`]\*['"`]|Access-Control-Allow-Origin['"]?\s*[,:]\s*['"]\*['"]|"""
                 r"""allow_origins\s*=\s*\[\s*['"]\*['"]|\bcors\(\s*\)|CORS\(\s*app\s*\))""")
JWT_JS = r"""(?i)\bjwt\.decode\s*\(|algorithms\s*:\s*\[\s*['"]none['"]"""
JWT_PY = r"""verify_signature['"]?\s*:\s*False|algorithms\s*=\s*\[\s*['"]none['"]"""
EXPOSED_ENV = (r"res\.(?:json|send)\s*\(\s*process\.env\s*\)|console\.log\s*\(\s*process\.env\s*\)|"
               r"jsonify\(\s*(?:dict\()?os\.environ|return\s+(?:dict\()?os\.environ\b|print\(\s*os\.environ\s*\)")
PATH_TRAVERSAL = (r"\b(?:fs\.(?:readFile|readFileSync|createReadStream|writeFile|writeFileSync|unlink|unlinkSync|"
                  r"readdir)|res\.sendFile|res\.download|send_file|open)\s*\([^)]*\b(?:req\.(?:params|query|body)|"
                  r"request\.(?:args|form|json|GET|POST|files))")
INSECURE_HTTP = (r"""['"`]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|www\.w3\.org|schemas\.|"""
                 r"""json-schema\.org|example\.(?:com|org|net))[^'"`\s]+""")
WEAK_HASH = r"""(?i)createHash\(\s*['"](?:md5|sha1)['"]|hashlib\.(?:md5|sha1)\s*\("""
INSECURE_RANDOM = r"(?i)(?:token|session|secret|password|nonce|otp)\w*\s*=.*Math\.random\(\)"
DOM_XSS = (r"""\.innerHTML\s*=\s*(?!\s*['"][^'"$]*['"]\s*;?\s*$)|\.outerHTML\s*=|document\.write\s*\(|"""
           r"""dangerouslySetInnerHTML|insertAdjacentHTML\s*\(""")
TOKEN_STORAGE = (r"""(?i)localStorage\.setItem\(\s*['"](?:token|jwt|auth|authToken|access_token|accessToken|id_token|"""
                 r"""session)['"]""")
TLS_DISABLED = (r"""rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0|verify\s*=\s*False|"""
                r"""InsecureSkipVerify:\s*true""")
DEBUG_ENABLED = r"\b(?:debug|DEBUG)\s*=\s*True\b"
MASS_ASSIGNMENT = (r"\.(?:create|insert|insertOne|update|updateOne|findOneAndUpdate|findByIdAndUpdate|save)\s*\(\s*"
                   r"req\.body\s*[,)]")
PROMPT_INJECTION = (r"(?i)\b(?:ignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+instructions|"
                    r"disregard\s+(?:all\s+)?(?:previous|prior|above)\s+instructions|"
                    r"reveal\s+(?:your|the)\s+system\s+prompt|"
                    r"send\s+(?:the|your)\s+(?:api\s+keys?|secrets?|credentials)\s+to)")
RISK_WORDS = (r"(?i)\b(auth|password|token|secret|jwt|query|exec|eval|cors|req\.body|request\.|cookie|session|crypto|"
              r"upload|admin|payment|card)\b")
SCANNER_FAMILIES = {
    "secrets": ["secret"],
    "injection": ["injection", "file", "xss", "validation"],
    "auth": ["jwt", "storage", "crypto"],
    "exposure": ["cors", "transport", "config", "exposure"],
    "prompt": ["prompt-injection"],
}
FAMILY_KEYWORDS = {
    "secret": ["secret", "api key", "hardcoded", "credential", "password", "token"],
    "injection": ["injection", "eval", "exec", "command", "sql"],
    "cors": ["cors", "origin"],
    "jwt": ["jwt", "signature"],
    "exposure": ["environment", "exposed", "leak"],
    "xss": ["xss", "innerhtml", "html"],
    "transport": ["http", "tls", "https", "certificate"],
    "crypto": ["md5", "sha1", "hash", "random"],
    "prompt-injection": ["prompt"],
}
# ---- end of fixed values ----


@dataclass(frozen=True)
class Rule:
    """One rule. ``hints`` are literals of which the lower-cased line must contain at least one."""

    id: str
    family: str
    title: str
    severity: str
    confidence: float
    cwe: str
    hints: tuple[str, ...]
    test: Callable[[Column], Column]
    kinds: tuple[str, ...] = SOURCE
    languages: tuple[str, ...] | None = None
    secret: Callable[[Column], Column] | None = None
    title_of: Callable[[Column], Column] | None = None
    skip_comments: bool = True
    description: str = ""
    recommendation: str = ""
    order: int = field(default=0, compare=False)


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda line: line.rlike(pattern)


def dynamic_string(line: Column) -> Column:
    return line.rlike(CONCAT) | line.rlike(TEMPLATE) | line.rlike(PY_FSTRING) | line.rlike(PY_FORMAT)


def secret_name(line: Column) -> Column:
    return F.regexp_extract(line, SECRET_ASSIGNMENT, 1)


def secret_value(line: Column) -> Column:
    return F.regexp_extract(line, SECRET_ASSIGNMENT, 3)


def known_key(line: Column) -> Column:
    return F.regexp_extract(line, KNOWN_KEY, 1)


def valid_secret(name: Column, value: Column) -> Column:
    """A plausible credential: no placeholder, version, marker or look-alike name; some entropy."""
    refused = (value.rlike(PLACEHOLDER_VALUE) | name.rlike(NON_SECRET_NAME) | value.rlike(VERSION_VALUE)
               | value.rlike(MARKER_VALUE))
    entropy = value.rlike(r"[\p{Ll}\p{Nd}]")
    return (value != "") & ~refused & entropy & (value.rlike(r"[\p{Nd}\-_./+=]") | (F.length(value) >= 16))


def secret_title(line: Column) -> Column:
    name = F.lower(secret_name(line))
    return (F.when(name.contains("jwt"), "Hardcoded JWT secret")
            .when(name.contains("api") & name.contains("key"), "Hardcoded API key")
            .when(name.contains("pass") | name.contains("pwd"), "Hardcoded password")
            .when(name.contains("private"), "Hardcoded private key")
            .when(name.contains("access"), "Hardcoded access key")
            .when(name.contains("token"), "Hardcoded token").otherwise("Hardcoded secret"))


def _rules() -> tuple[Rule, ...]:
    return (
        Rule("hardcoded-secret", "secret", "Hardcoded secret", "high", 0.9, "CWE-798",
             ("key", "secret", "passw", "pwd", "token"), lambda s: valid_secret(secret_name(s), secret_value(s)),
             ("source", "config"), None, secret_value, secret_title, False,
             "A credential is assigned in source, where every reader and build artifact can see it.",
             "Move the value to the environment or a secret manager and rotate it."),
        Rule("known-key-format", "secret", "Credential with a known key format", "high", 0.95, "CWE-798",
             ("sk-", "akia", "ghp_", "github_pat_", "xox", "aiza", "sk_live_"), _matches(KNOWN_KEY), EVERYTHING, None,
             known_key, None, False, "The value has the format of a provider credential.",
             "Revoke the key, remove it from history and load it from the environment."),
        Rule("private-key", "secret", "Private key committed to the repository", "critical", 0.97, "CWE-321",
             ("private key-----",), _matches(PRIVATE_KEY), EVERYTHING, None, None, None, False,
             "A private key block is stored in the repository.", "Remove and rotate the key."),
        Rule("sql-injection", "injection", "SQL query built with string concatenation", "high", 0.85, "CWE-89",
             ("select", "insert", "update", "delete"), lambda s: s.rlike(SQL_KEYWORDS) & dynamic_string(s),
             description="Values are concatenated into a SQL statement.", recommendation="Use bound parameters."),
        Rule("command-injection", "injection", "Shell command built from dynamic input", "high", 0.8, "CWE-78",
             ("exec", "spawn"), lambda s: s.rlike(JS_EXEC) & (dynamic_string(s) | s.contains("${")), SOURCE, JS,
             description="A shell command is assembled from variables.",
             recommendation="Pass an argument array and check inputs against an allow-list."),
        Rule("command-injection-py", "injection", "Shell command built from dynamic input", "high", 0.8, "CWE-78",
             ("os.system", "os.popen", "subprocess"),
             lambda s: s.rlike(PY_SHELL_TRUE) | (s.rlike(PY_SHELL) & (dynamic_string(s) | s.contains("+"))),
             SOURCE, PY, description="A command runs through the shell with dynamic input.",
             recommendation="Pass a list of arguments with shell=False."),
        Rule("unsafe-eval", "injection", "Dynamic code execution (eval)", "high", 0.88, "CWE-95",
             ("eval", "function", "settimeout", "setinterval"), _matches(UNSAFE_EVAL), SOURCE, JS,
             description="Strings are executed as code.", recommendation="Parse explicitly instead of eval."),
        Rule("unsafe-eval-py", "injection", "Dynamic code execution (eval/exec)", "high", 0.85, "CWE-95",
             ("eval", "exec"), _matches(UNSAFE_EVAL_PY), SOURCE, PY,
             description="Strings are executed as Python code.", recommendation="Use ast.literal_eval or a parser."),
        Rule("insecure-cors", "cors", "Permissive CORS policy", "medium", 0.82, "CWE-942", ("origin", "cors"),
             _matches(INSECURE_CORS), description="Any origin may call the API.",
             recommendation="Restrict allowed origins."),
        Rule("jwt-no-verify", "jwt", "JWT decoded without signature verification", "high", 0.86, "CWE-347",
             ("jwt.decode", "algorithms"), _matches(JWT_JS), SOURCE, JS,
             description="The token is decoded but its signature is not checked.",
             recommendation="Verify with the signing secret and explicit algorithms."),
        Rule("jwt-no-verify-py", "jwt", "JWT signature verification disabled", "high", 0.86, "CWE-347",
             ("verify_signature", "algorithms"), _matches(JWT_PY), SOURCE, PY,
             description="Signature verification is off.", recommendation="Keep it on and pin algorithms."),
        Rule("exposed-env", "exposure", "Environment variables exposed", "high", 0.9, "CWE-200",
             ("process.env", "os.environ"), _matches(EXPOSED_ENV),
             description="The whole environment is returned or logged.",
             recommendation="Return an allow-list of safe values."),
        Rule("path-traversal", "file", "File path built from request input", "medium", 0.75, "CWE-22",
             ("req.", "request."), _matches(PATH_TRAVERSAL),
             description="A file operation uses request input.", recommendation="Resolve below a fixed base folder."),
        Rule("insecure-http", "transport", "Unencrypted HTTP endpoint", "medium", 0.8, "CWE-319", ("http://",),
             _matches(INSECURE_HTTP), description="Data is sent over plain HTTP.", recommendation="Use HTTPS."),
        Rule("weak-hash", "crypto", "Weak hash algorithm (MD5/SHA-1)", "medium", 0.85, "CWE-327",
             ("createhash", "hashlib"), _matches(WEAK_HASH), description="MD5 and SHA-1 are broken for security use.",
             recommendation="Use a password hash or SHA-256."),
        Rule("insecure-random", "crypto", "Insecure randomness for security values", "low", 0.7, "CWE-338",
             ("math.random",), _matches(INSECURE_RANDOM), SOURCE, JS,
             description="Math.random() is predictable.", recommendation="Use a cryptographic generator."),
        Rule("dom-xss", "xss", "Unsanitized HTML injection (XSS)", "medium", 0.78, "CWE-79",
             ("html", "document.write"), _matches(DOM_XSS), SOURCE, JS,
             description="Dynamic content is written into the page as HTML.", recommendation="Use textContent."),
        Rule("token-localstorage", "storage", "Auth token stored in localStorage", "low", 0.7, "CWE-922",
             ("localstorage",), _matches(TOKEN_STORAGE), SOURCE, JS,
             description="Page scripts can read the token.", recommendation="Prefer HttpOnly cookies."),
        Rule("tls-disabled", "transport", "TLS certificate verification disabled", "medium", 0.82, "CWE-295",
             ("rejectunauthorized", "node_tls", "verify", "insecureskipverify"), _matches(TLS_DISABLED),
             SOURCE_CONFIG, description="Certificate verification is off.",
             recommendation="Keep it on and configure a trusted bundle."),
        Rule("debug-enabled", "config", "Debug mode enabled", "low", 0.7, "CWE-489", ("debug",),
             _matches(DEBUG_ENABLED), SOURCE_CONFIG, ("python", "yaml", "ini", "toml", "dotenv"),
             description="Debug mode shows internals to users.", recommendation="Turn it off outside development."),
        Rule("mass-assignment", "validation", "Request body passed directly to the data layer", "medium", 0.72,
             "CWE-915", ("req.body",), _matches(MASS_ASSIGNMENT),
             description="The raw request body is stored.", recommendation="Copy only allowed fields."),
        Rule("prompt-injection", "prompt-injection", "Prompt-injection text targeting AI tools", "low", 0.8,
             "CWE-1427", ("instructions", "prompt", "send"), _matches(PROMPT_INJECTION), EVERYTHING, None, None, None,
             False, "The text addresses AI tools that read the repository.", "Remove the instruction text."),
    )


RULES: tuple[Rule, ...] = tuple(Rule(**{**r.__dict__, "order": i}) for i, r in enumerate(_rules()))
RULE_FAMILY = {r.id: r.family for r in RULES}


def is_comment(line: Column, language: Column) -> Column:
    text = tx.lstrip(line)
    marks = text.startswith("//") | text.startswith("/*") | text.startswith("*") | text.startswith("<!--")
    return (marks | (text.startswith("#") & language.isin(HASH_COMMENT_LANGUAGES))
            | (text.startswith("--") & (language == "sql")))


def mask(value: Column) -> Column:
    return F.when(F.length(value) > 4, F.concat(F.substring(value, 1, 4), F.lit("[REDACTED]"))).otherwise("[REDACTED]")


def _applies(rule: Rule, line: Column, low: Column, kind: Column, language: Column, comment: Column) -> Column:
    hinted = low.contains(rule.hints[0])
    for hint in rule.hints[1:]:
        hinted = hinted | low.contains(hint)
    test = kind.isin(list(rule.kinds)) & hinted
    if rule.languages is not None:
        test = language.isin(list(rule.languages)) & test
    if rule.skip_comments:
        test = test & ~comment
    return test & rule.test(line)


def _describe(rules: Sequence[Rule], line: Column, index: Column) -> list[Column]:
    """Columns of a hit, looked up by rule index; secrets are masked in the evidence."""
    def lookup(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)

    text = tx.strip(line)
    title = lookup([r.title for r in rules])
    for i, r in enumerate(rules):
        if r.title_of is not None:
            title = F.when(index == i, r.title_of(line)).otherwise(title)
        if r.secret is not None:
            value = r.secret(line)
            masked = F.replace(tx.strip(line), value, mask(value))
            text = F.when((index == i) & (value != ""), masked).otherwise(text)
    return [lookup([r.order for r in rules]).alias("rule_order"), lookup([r.id for r in rules]).alias("rule_id"),
            lookup([r.family for r in rules]).alias("family"), lookup([r.severity for r in rules]).alias("severity"),
            title.alias("title"), tx.ellipsis(text, 220, 217).alias("evidence"),
            lookup([r.confidence for r in rules]).alias("confidence"), lookup([r.cwe for r in rules]).alias("cwe")]


def _any_hint(rules: Sequence[Rule], low: Column, language: Column) -> Column:
    """Whether the line holds a hint of a rule for its language: hints of the other rules cannot make a hit."""
    by_languages: dict[tuple[str, ...] | None, set[str]] = {}
    for r in rules:
        by_languages.setdefault(r.languages, set()).update(r.hints)
    every = by_languages.pop(None, set())
    test = _holds(low, every)
    for languages, hints in by_languages.items():
        test = test | (language.isin(list(languages)) & _holds(low, hints - every))
    return test


def _holds(low: Column, literals: set[str]) -> Column:
    """A literal that holds another one is not looked for."""
    test = F.lit(False)
    for x in sorted(literals):
        if not any(y != x and y in x for y in literals):
            test = test | low.contains(x)
    return test


def scan_lines(lines: DataFrame, rules: Sequence[Rule] = RULES, max_line: int | None = None) -> DataFrame:
    """All hits of ``rules`` over (.., path, line_no, line, kind, language).

    One narrow pass: lines without any hint literal are dropped inside generated code, the rules run
    on the rest, and titles and evidence are worked out only for hits.
    """
    line = F.col("line")
    keep = [c for c in lines.columns if c not in ("line", "kind", "language")]
    # a one-row explode keeps lower() and the comment test from being inlined into every rule
    prepared = F.array(F.struct(F.lower("line").alias("low"), is_comment(line, F.col("language")).alias("comment")))
    short = F.lit(True) if max_line is None else F.length("line") <= max_line
    ready = (lines.where(short & (tx.lstrip(line) != ""))
             .select("*", F.explode(prepared).alias("_p"))
             .where(_any_hint(rules, F.col("_p.low"), F.col("language"))))
    flags = F.array_compact(F.array(*[
        F.when(_applies(r, line, F.col("_p.low"), F.col("kind"), F.col("language"), F.col("_p.comment")), F.lit(i))
        for i, r in enumerate(rules)]))
    hits = ready.select(*keep, "line", F.explode(flags).alias("_rule"))
    return hits.select(*keep, *_describe(rules, line, F.col("_rule")))


def cap_per_file(hits: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` hits of a rule in a file. Row-number limits prune before the shuffle."""
    w = Window.partitionBy("repo_id", "path", "rule_id").orderBy("line_no")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def cap_total(hits: DataFrame, cap: int = 200) -> DataFrame:
    """First ``cap`` claims in (path, line, rule) order; off by default, a parameter of callers."""
    return hits.orderBy("repo_id", "path", "line_no", "rule_order").limit(cap)


def scan(lines: DataFrame, rules: Sequence[Rule] = RULES, cap: int | None = None, max_line: int | None = None) -> DataFrame:
    """Hits of all lines; with ``cap`` the first ones of a rule in a file, with ``max_line`` only of lines so long at most."""
    hits = scan_lines(lines, rules, max_line)
    return hits if cap is None else cap_per_file(hits, cap)


def rules_of(scanner: str) -> tuple[Rule, ...]:
    return tuple(r for r in RULES if r.family in SCANNER_FAMILIES[scanner])


def infer_family(title: Column) -> Column:
    low = F.lower(title)
    found = None
    for family, words in FAMILY_KEYWORDS.items():
        test = low.contains(words[0])
        for w in words[1:]:
            test = test | low.contains(w)
        found = F.when(test, family) if found is None else found.when(test, family)
    return found


def risk_ranked_files(files: DataFrame, hits: DataFrame, limit: int = 6, focus: DataFrame | None = None) -> DataFrame:
    """Files by 3 per hit, 1 per risk word and up to 10 for their focus rank; top ``limit`` per repository.

    ``focus`` holds (repo_id, path, rank) with rank counted from zero.
    """
    words = F.aggregate(F.transform("lines", lambda s: F.regexp_count(s, F.lit(RISK_WORDS))), F.lit(0),
                        lambda a, x: a + x)
    counts = hits.groupBy("repo_id", "path").agg(F.count("*").alias("hits"))
    scored = files.where("kind = 'source'").select("repo_id", "path", words.alias("words")).join(
        counts, ["repo_id", "path"], "left")
    bonus = F.lit(0)
    if focus is not None:
        scored = scored.join(focus, ["repo_id", "path"], "left")
        bonus = F.coalesce(F.greatest(F.lit(0), F.lit(10) - F.col("rank")), F.lit(0))
    scored = scored.withColumn("score", F.coalesce("hits", F.lit(0)) * 3 + F.col("words") + bonus).where("score > 0")
    w = Window.partitionBy("repo_id").orderBy(F.desc("score"), "path")
    return (scored.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= limit)
            .select("repo_id", "path", "score", "rank_no"))
