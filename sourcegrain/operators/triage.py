"""Issue triage and test outcomes: signals, suspects, test logs, gate, patch headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.sieve import may_hold, sieve
from sourcegrain.functions.stages import hold
from sourcegrain.operators import facts as C

# ---- fixed values: stop words, patterns, kinds, noise, test folders ----
STOPWORDS = """a an the is are was were be been being do does did doing have has had when while then than
that this these those there here it its it's if else for from with without into onto about above below over under
and or not no none null nil true false but so such very only just also too then now new old some any all each both
i we you they he she my our your their me us them as at by in on of to up out off again once more most other same
should would could can cannot will shall may might must need needs get gets got getting make makes made making
happens happen happened issue bug problem error fails failing failed fail broken break breaks expected actual
instead currently please thanks report reported steps reproduce reproduction repro description summary title
version behavior behaviour result results returns return returned returning value values code line lines file files
function functions method methods class classes test tests case cases add added adds adding fix fixed fixes fixing
support supports use used uses using work works working""".split()
QUOTED = r"`([^`\n]{2,80})`|\"([^\"\n]{3,80})\"|'([^'\n]{3,80})'"
PATH_LIKE = r"\b[\w./-]+\.(?:py|js|jsx|ts|tsx|mjs|cjs|go|rb|rs|java|php|cs|kt|swift|vue|svelte)\b"
IDENTIFIER = (r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\s*\(\)?|\b([a-z]+(?:[A-Z]\w+)+)\b"
              r"|\b([A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*)\b|\b([a-z_]+_[a-z_0-9]+)\b")
EXCEPTION = r"\b([A-Z][A-Za-z0-9]*(?:Error|Exception|Warning))\b(?::\s*([^\n]{0,120}))?"
PY_FRAME = r'File "([^"]+)", line (\d+)'
JS_FRAME = r"at [^\s(]+ \(([\w./-]+):(\d+):\d+\)"
NUMBERED = r"(?m)^\s*(?:\d+[.)]|[-*•])\s+(.+)$"
EXPECTED = r"(?im)^\W*(?:expected|should|must|want(?:ed)?|desired)\b[:\s]*(.{4,200})$"
ACTUAL = r"(?im)^\W*(?:actual|but|instead|currently|observed|got|returns?)\b[:\s]*(.{4,200})$"
TEST_NAME = r"\b((?:test_[\w]+|[\w]+_test|test[A-Z]\w+))\b"
KINDS = {
    "crash": ["crash", "traceback", "stack trace", "exception", "segfault", "panic", "unhandled"],
    "regression": ["regression", "used to work", "worked before", "since version", "after upgrading", "broke"],
    "incorrect-behavior": ["wrong", "incorrect", "unexpected", "should return", "expected", "mismatch", "off by"],
    "performance": ["slow", "timeout", "hangs", "memory leak", "performance", "cpu", "latency"],
    "feature": ["add support", "feature request", "would be nice", "implement", "please add", "enhancement"],
    "security": ["vulnerab", "injection", "xss", "csrf", "secret", "credential", "auth bypass"],
}
NOISE = """assert assertion assertionerror error self def return true false none not and or in is if else for while import
from class raise with as lambda expect tobe equal e at the of to""".split()
BLAMED = r"where\s+.+?=\s*([A-Za-z_][A-Za-z0-9_]*)\s*\("
TEST_DIRS = ["test", "tests", "spec", "specs", "__tests__", "testing"]
CLEAR_TEST = r"^.+(?:_test|_spec)\.[a-z]+$|^.+\.(?:test|spec)\.[a-z]+$"
PREFIXED_TEST = r"^test_.+\.[a-z]+$"
TOP_TERMS, TEST_WEIGHT = 40, 0.35
# ---- end of fixed values ----


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def weighted_terms(issues: DataFrame, limit: int | None = TOP_TERMS) -> DataFrame:
    """(issue_id, term, weight, rank): how strongly an issue text points at each term."""
    text = F.col("text")
    title = tx.strip(F.try_element_at(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"\S")), F.lit(1)))
    emphasis = F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), _all(text, EXPECTED, 1), _all(text, ACTUAL, 1)), " ")
    df = hold(issues.select("issue_id", "text"), emphasis=emphasis)
    clean = lambda t: F.regexp_replace(tx.strip(t), r"""^[`"'.,:;()\[\]{}]+|[`"'.,:;()\[\]{}]+$""", "")
    useful = lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOPWORDS)
    names = lambda *found: F.array_distinct(F.filter(F.transform(F.concat(*found), clean), useful))
    df = hold(df, n3=names(*[_all(text, QUOTED, g) for g in (1, 2, 3)], _all(text, PATH_LIKE, 0)), n25=names(_all(text, EXCEPTION, 1)),
              n2=names(*[_all(text, IDENTIFIER, g) for g in (1, 2, 3, 4)]), n1=names(_all(text, r"[A-Za-z][A-Za-z0-9_-]{2,}", 0)))
    # each term once per text, with the weight of the strongest kind; it is counted there, so no text is dealt by term
    weigh = lambda arr, w: F.transform(arr, lambda t: F.struct(t.alias("t"), F.lit(w).alias("w")))
    found = F.concat(weigh(F.col("n3"), 3.0), weigh(F.array_except("n25", "n3"), 2.5), weigh(F.array_except("n2", F.concat("n3", "n25")), 2.0),
                     weigh(F.array_except("n1", F.concat("n3", "n25", "n2")), 1.0))
    # a term of word characters is a whole run of them: runs stand between blanks, two from each other, and are looked up as
    # literals; only other terms need a pattern of their own
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\W+", "  "), F.lit(" "))
    df = hold(df.select("issue_id", "text", "emphasis", found.alias("found")), runs=spaced(text), stressed_runs=spaced(F.col("emphasis")))
    rows = df.select("issue_id", "text", "emphasis", "runs", "stressed_runs", F.explode("found").alias("x"))
    rows = rows.select("issue_id", "text", "emphasis", "runs", "stressed_runs", F.col("x.t").alias("term"), F.col("x.w").alias("w"))
    plain, run = F.rlike("term", F.lit(r"^\w+\z")), F.concat(F.lit(" "), F.col("term"), F.lit(" "))
    word = F.concat(F.lit(r"(?<!\w)"), tx.regex_quote(F.col("term")), F.lit(r"(?!\w)"))
    rows = rows.select("issue_id", "term", "w", F.when(plain, tx.count_of(F.col("runs"), run)).otherwise(F.regexp_count("text", word)).alias("n"),
                       F.when(plain, F.contains("stressed_runs", run)).otherwise(F.rlike(F.col("emphasis"), word)).alias("stressed"))
    rows = rows.repartition("issue_id")  # once, for the terms and for their ranks
    best = rows.groupBy("issue_id", "term").agg(F.max("w").alias("w"), F.first("n").alias("n"), F.first("stressed").alias("stressed"))
    score = F.col("w") + F.least(F.lit(1.5), 0.25 * (F.col("n") - 1)) + F.when(F.col("stressed"), 1.5).otherwise(0.0)
    out = best.select("issue_id", "term", score.alias("weight"))
    w = Window.partitionBy("issue_id").orderBy(F.desc("weight"), F.lower("term"), "term")
    out = out.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def issue_signals(issues: DataFrame) -> DataFrame:
    """One row of arrays per issue: kinds, exceptions, frames, paths, expected and actual lines, steps, tests."""
    text, low = F.col("text"), F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    kinds = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(k)) for k, words in KINDS.items()]))
    zipped = lambda p: F.zip_with(_all(text, p, 1), _all(text, p, 2), lambda a, b: F.concat_ws(":", a, b))
    stripped = lambda arr, n: F.slice(F.transform(arr, lambda x: tx.strip(x)), 1, n)
    return issues.select(
        "issue_id", F.when(F.size(kinds) == 0, F.array(F.lit("unspecified"))).otherwise(kinds).alias("kinds"),
        F.slice(_all(text, EXCEPTION, 1), 1, 4).alias("exceptions"), F.slice(F.concat(zipped(PY_FRAME), zipped(JS_FRAME)), 1, 8).alias("frames"),
        F.array_sort(F.array_distinct(_all(text, PATH_LIKE, 0))).alias("paths"), stripped(_all(text, EXPECTED, 1), 4).alias("expected"),
        stripped(_all(text, ACTUAL, 1), 4).alias("actual"), stripped(_all(text, NUMBERED, 1), 8).alias("steps"),
        F.slice(F.array_sort(F.array_distinct(_all(text, TEST_NAME, 1))), 1, 8).alias("test_names"))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return F.exists(tx.dir_parts(low), lambda d: d.isin(TEST_DIRS)) | tx.base_name(low).rlike(r"^(test_.*|.*_test|.*\.(?:test|spec))\.[a-z]+$")


def suspects(terms: DataFrame, signals: DataFrame, parsed: DataFrame, limit: int | None = 8) -> DataFrame:
    """Code windows ranked by evidence: stack frames, paths, defined symbols and literal mentions.

    Terms meet symbols by name and lines by word, so no issue is compared with every file. A path or frame
    meets files by its base name first.
    """
    files = hold(parsed.select("repo_id", "path", "symbols", F.size("lines").alias("n")), base=tx.base_name(F.col("path")))
    frames = signals.select("issue_id", F.explode("frames").alias("f")).select("issue_id", F.substring_index("f", ":", 1).alias("ref"), F.substring_index("f", ":", -1).cast("int").alias("at"))
    frames = frames.select("issue_id", "ref", "at", F.lit(6.0).alias("weight"), F.concat(F.lit("named in the stack trace at line "), F.col("at").cast("string")).alias("reason"))
    paths = signals.select("issue_id", F.explode("paths").alias("ref")).select("issue_id", "ref", F.lit(1).alias("at"), F.lit(2.0).alias("weight"), F.lit("named in the issue").alias("reason"))
    refs = frames.unionByName(paths).withColumn("base", tx.base_name(F.col("ref")))
    named = refs.join(files, "base").where((F.col("path") == F.col("ref")) | F.endswith("path", F.concat(F.lit("/"), tx.drop_dot_slash(F.col("ref")))))
    named = named.select("issue_id", "repo_id", "path", F.least(F.col("at"), F.greatest("n", F.lit(1))).alias("line"), "weight", "reason")
    symbols = C.table(parsed, "symbols").select("repo_id", "path", F.col("name").alias("term"), F.col("line_start").alias("line"))
    defined = terms.where("rank <= 14").join(symbols, "term").select("issue_id", "repo_id", "path", "line", (1.4 * F.col("weight")).alias("weight"),
                                                                     F.concat(F.lit("defines `"), "term", F.lit("`")).alias("reason"))
    wanted = terms.where("rank <= 10 AND length(term) >= 4")
    words = parsed.where("kind = 'source'").select("repo_id", "path", F.posexplode("lines").alias("i", "s"))
    words = words.select("repo_id", "path", (F.col("i") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    # literal terms start with a word of the line; single-word terms are the word itself
    simple = wanted.where(F.col("term").rlike(r"^\w+$")).select("issue_id", "term", "weight")
    asked = simple.select(F.col("term").alias("word")).distinct()
    words = words.where(may_hold(sieve(asked, "word"), F.col("word")))  # few words are asked for; the others are not dealt out
    first = words.join(asked, "word").groupBy("repo_id", "path", "word").agg(
        F.slice(F.array_sort(F.collect_set("line")), 1, 3).alias("at"))
    mention = first.join(simple.withColumnRenamed("term", "word"), "word").select(
        "issue_id", "repo_id", "path", F.explode("at").alias("line"), (0.5 * F.col("weight") / F.size("at")).alias("weight"), F.concat(F.lit("mentions `"), "word", F.lit("`")).alias("reason"))
    evidence = named.unionByName(defined).unionByName(mention)
    placed = evidence.join(files.select("repo_id", "path", "symbols", "n"), ["repo_id", "path"])
    placed = hold(placed, s=C.symbol_at(F.col("symbols"), F.col("line"))).drop("symbols")
    start = F.coalesce("s.line_start", F.greatest(F.lit(1), F.col("line") - 5))
    end = F.when(F.col("s").isNotNull(), F.least("s.line_end", F.col("s.line_start") + 40)).otherwise(F.least(F.col("n"), F.col("line") + 15))
    weight = F.col("weight") * F.when(is_test_file(F.col("path")), TEST_WEIGHT).otherwise(1.0)
    rolled = placed.select("issue_id", "repo_id", "path", start.alias("line_start"), end.alias("line_end"), F.col("s.name").alias("symbol"), weight.alias("weight"), "reason")
    rolled = rolled.groupBy("issue_id", "repo_id", "path", "line_start", "line_end").agg(
        F.sum("weight").alias("score"), F.max("symbol").alias("symbol"), F.slice(F.array_sort(F.collect_set("reason")), 1, 4).alias("reasons"))
    if limit is None:
        return rolled
    w = Window.partitionBy("issue_id").orderBy(F.desc(F.round("score", 6)), "repo_id", "path", "line_start")
    return rolled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def failure_signals(logs: DataFrame) -> DataFrame:
    """(run_id, name, weight): names the failing output blames."""
    rows = logs.select("run_id", F.explode(tx.split_lines(F.col("text"))).alias("s")).where(F.col("s").rlike(r"^[>E]\s"))
    blamed = F.transform(_all(F.col("s"), BLAMED, 1), lambda n: F.struct(n.alias("name"), F.lit(3.0).alias("w")))
    stated = F.when(F.col("s").startswith(">"), F.transform(_all(F.col("s"), r"[A-Za-z_][A-Za-z0-9_]*", 0), lambda n: F.struct(n.alias("name"), F.lit(1.5).alias("w"))))
    rows = rows.select("run_id", F.explode(F.concat(blamed, F.coalesce(stated, F.slice(blamed, 1, 0)))).alias("x"))
    return rows.where((F.length("x.name") > 2) & ~F.lower("x.name").isin(NOISE)).groupBy("run_id", F.col("x.name").alias("name")).agg(F.sum("x.w").alias("weight"))


def rerank(found: DataFrame, signals: DataFrame) -> DataFrame:
    """Suspects (run_id, symbol, score, path, line_start) with the failure bonus added, in new order."""
    bonus = signals.select("run_id", F.col("name").alias("symbol"), F.col("weight").alias("bonus"))
    out = found.join(bonus, ["run_id", "symbol"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 2))
    w = Window.partitionBy("run_id").orderBy(F.desc("score"), "path", "line_start")
    return out.withColumn("rank", F.row_number().over(w)).drop("bonus")


def covering_tests(parsed: DataFrame, leading: DataFrame, limit: int = 6) -> DataFrame:
    """Test files whose stem names a suspect's file or whose text mentions its symbol, per issue."""
    tests = parsed.where(is_test_file(F.col("path"))).select("repo_id", "path", "lines")
    core = F.regexp_replace(tx.stem(F.col("path")), r"^test[_.]|[_.]test$|\.spec$", "")
    by_stem = tests.select("repo_id", F.col("path").alias("test"), core.alias("stem")).join(
        leading.select("issue_id", "repo_id", tx.stem(F.col("path")).alias("stem")).distinct(), ["repo_id", "stem"]).select("issue_id", "repo_id", "test")
    words = tests.select("repo_id", F.col("path").alias("test"), F.explode(F.array_distinct(F.regexp_extract_all(tx.join_lines(F.col("lines")), F.lit(r"\w+"), F.lit(0)))).alias("symbol"))
    by_symbol = words.join(leading.where("symbol IS NOT NULL").select("issue_id", "repo_id", "symbol").distinct(), ["repo_id", "symbol"]).select("issue_id", "repo_id", "test")
    w = Window.partitionBy("issue_id").orderBy("repo_id", "test")
    return by_stem.union(by_symbol).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def plan_steps(ranked: DataFrame, signals: DataFrame) -> DataFrame:
    """Ordered steps per issue: inspect the first three suspects, change the best one, run tests, run the gate."""
    look = ranked.where("rank <= 3").select("issue_id", F.col("rank").alias("o"), F.concat(F.lit("Inspect "), F.coalesce("symbol", F.lit("this range")), F.lit(" in "), "path").alias("action"), "path")
    pick = F.struct(F.col("symbol").isNull(), F.col("rank"))
    change = ranked.groupBy("issue_id").agg(F.min_by(F.struct("symbol", "path"), pick).alias("p")).select(
        "issue_id", F.lit(10).alias("o"), F.concat(F.lit("Change "), F.coalesce("p.symbol", "p.path")).alias("action"), F.col("p.path").alias("path"))
    none = F.lit(None).cast("string")
    test = signals.select("issue_id", F.lit(20).alias("o"), F.lit("Run the covering tests").alias("action"), none.alias("path"))
    gate = signals.select("issue_id", F.lit(30).alias("o"), F.lit("Run the gate").alias("action"), none.alias("path"))
    whole = look.union(change).union(test).union(gate)
    w = Window.partitionBy("issue_id").orderBy("o")
    return whole.withColumn("step", F.row_number().over(w)).select("issue_id", "step", "action", "path")


def parse_logs(logs: DataFrame) -> DataFrame:
    """Counts and the first twenty failing ids of test logs (run_id, runner, exit_code, text)."""
    t, runner = F.col("text"), F.col("runner")

    def tally(pattern: str, text: Column = t) -> Column:
        """Last count per word of a ``<count> <word>`` pattern, as a map."""
        pairs = F.zip_with(_all(text, pattern, 2), _all(text, pattern, 1), lambda k, n: F.struct(k.alias("key"), n.cast("int").alias("value")))
        return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    of = lambda m, *names: sum((F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(0)) for n in names), F.lit(0))
    num = lambda p, g=1, text=t: F.when(text.rlike(p), F.regexp_extract(text, p, g).cast("int"))
    jest = F.regexp_extract(t, r"Tests:\s+(.+)", 1)
    ut = F.aggregate(F.zip_with(_all(t, r"(failures|errors|skipped)=(\d+)", 1), _all(t, r"(failures|errors|skipped)=(\d+)", 2), lambda k, n: F.struct(k.alias("key"), n.cast("int").alias("value"))),
                     F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")),
                     lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    df = hold(logs, py=tally(r"(\d+)\s+(passed|failed|errors|error|skipped|xfailed|xpassed)"), js=tally(r"(\d+)\s+(passed|failed|skipped|todo)", jest), ut=ut,
              ran=num(r"(?m)^Ran (\d+) tests?"), mp=num(r"(?m)^\s*(\d+)\s+passing"), mf=num(r"(?m)^\s*(\d+)\s+failing"))
    cargo = r"test result:\s+\w+\.\s+(\d+) passed;\s+(\d+) failed;\s+(\d+) ignored"
    cargo_sum = lambda g: F.when(t.rlike(cargo), F.aggregate(_all(t, cargo, g), F.lit(0), lambda a, x: a + x.cast("int")))
    section = F.when(t.contains("failures:"), F.regexp_extract(t, r"(?s)^.*?failures:(.*)$", 1)).otherwise("")
    failing = (F.when(runner == "pytest", _all(t, r"(?m)^(?:FAILED|ERROR)\s+(\S+)", 1)).when(runner == "unittest", _all(t, r"(?m)^(?:FAIL|ERROR):\s+(\S+)", 1))
               .when(runner == "npm", F.transform(_all(t, r"(?m)^\s*(?:✕|✗|×|not ok \d+ -)\s*(.+)$", 1), lambda x: tx.strip(x)))
               .when(runner == "go", _all(t, r"(?m)^--- FAIL: (\S+)", 1)).when(runner == "cargo", _all(section, r"(?m)^\s{4}(\S+)$", 1)))
    df = hold(df, failing=F.slice(F.array_distinct(failing), 1, 20))
    has_py, has_ut, has_js, has_mocha = F.size("py") > 0, F.col("ran").isNotNull(), jest != "", F.col("mp").isNotNull() | F.col("mf").isNotNull()
    passed = (F.when(runner == "pytest", F.when(has_py, of(F.col("py"), "passed", "xpassed")))
              .when(runner == "unittest", F.when(has_ut, F.greatest(F.lit(0), F.col("ran") - of(F.col("ut"), "failures", "errors", "skipped"))))
              .when(runner == "npm", F.when(has_js, of(F.col("js"), "passed")).when(has_mocha, F.coalesce("mp", F.lit(0)))).when(runner == "cargo", cargo_sum(1)))
    failed = (F.when(runner == "pytest", F.when(has_py, of(F.col("py"), "failed"))).when(runner == "unittest", F.when(has_ut, of(F.col("ut"), "failures")))
              .when(runner == "npm", F.when(has_js, of(F.col("js"), "failed")).when(has_mocha, F.coalesce("mf", F.lit(0))))
              .when(runner == "go", F.nullif(F.size("failing"), F.lit(0))).when(runner == "cargo", cargo_sum(2)))
    skipped = (F.when(runner == "pytest", F.when(has_py, of(F.col("py"), "skipped", "xfailed"))).when(runner == "unittest", F.when(has_ut, of(F.col("ut"), "skipped")))
               .when((runner == "npm") & has_js, of(F.col("js"), "skipped", "todo")).when(runner == "cargo", cargo_sum(3)))
    errors = F.when((runner == "pytest") & has_py, of(F.col("py"), "error", "errors")).when((runner == "unittest") & has_ut, of(F.col("ut"), "errors"))
    return df.select("run_id", "runner", "exit_code", passed.cast("int").alias("passed"), failed.cast("int").alias("failed"), skipped.cast("int").alias("skipped"),
                     errors.cast("int").alias("errors"), "failing")


def outcome(exit_code: Column, failed: Column, errors: Column, failing: Column, timed_out: Column) -> Column:
    bad = (F.coalesce(failed, F.lit(0)) > 0) | (F.coalesce(errors, F.lit(0)) > 0) | (F.coalesce(failing, F.lit(0)) > 0)
    return F.when(timed_out, "timeout").when(exit_code == 0, "passed").when(bad, "failed").otherwise("error")


def test_paths(files: DataFrame) -> DataFrame:
    """Which paths are tests; a ``test_`` name outside test folders needs neighbours of its kind."""
    low = F.lower("path")
    parts = tx.dir_parts(low)
    rows = files.select("repo_id", "path", F.array_join(parts, "/").alias("dir"), tx.base_name(low).alias("name"), parts.alias("parts"))
    ext = F.substring_index("name", ".", -1)
    rows = rows.withColumn("prefixed", F.col("name").rlike(PREFIXED_TEST)).withColumn("ext", ext)
    by_dir = rows.groupBy("repo_id", "dir").agg(F.count_if("prefixed").alias("n_prefixed"))
    by_ext = rows.groupBy("repo_id", "dir", "ext").agg(F.count("*").alias("n_ext"))
    rows = rows.join(by_dir, ["repo_id", "dir"]).join(by_ext, ["repo_id", "dir", "ext"])
    suite = (F.size("parts") == 0) | (F.col("n_prefixed") >= 2) | (F.col("n_prefixed") == F.col("n_ext"))
    test = F.exists("parts", lambda p: p.isin(TEST_DIRS)) | F.col("name").rlike(CLEAR_TEST) | (F.col("prefixed") & suite)
    return rows.select("repo_id", "path", test.alias("is_test"))


def gate(sessions: DataFrame, results: DataFrame, changes: DataFrame, require_new_test: bool = False, allow_test_edits: bool = False) -> DataFrame:
    """Verdict per session: sessions (session_id, before_status, after_status), results (session_id, phase, test_id, outcome),
    changes (session_id, path, is_test)."""
    failing = results.where("outcome = 'failed'")
    before = failing.where("phase = 'before'").select("session_id", "test_id")
    after = failing.where("phase = 'after'").select("session_id", "test_id")
    fixed = before.join(after, ["session_id", "test_id"], "left_anti").groupBy("session_id").agg(F.count("*").alias("fixed"))
    changed = changes.groupBy("session_id").agg(F.count("*").alias("changed"), F.count_if("is_test").alias("tests_changed"))
    proof = before.select("session_id", F.substring_index("test_id", "::", 1).alias("path")).distinct()
    edited = changes.join(proof, ["session_id", "path"], "left_semi").groupBy("session_id").agg(F.count("*").alias("rewritten"))
    s = sessions.join(fixed, "session_id", "left").join(changed, "session_id", "left").join(edited, "session_id", "left").fillna(0)
    ok_change, ok_tests = F.col("changed") > 0, F.col("after_status") == "passed"
    had_failure = F.col("before_status") == "failed"
    baseline = F.when(had_failure, ok_tests | (F.col("fixed") > 0)).otherwise(F.col("tests_changed") > 0)
    intact = F.lit(True) if allow_test_edits else (~had_failure | (F.col("rewritten") == 0))
    new_test = (~had_failure | (F.col("tests_changed") > 0)) if require_new_test else F.lit(True)
    # without a test run nothing can be decided; an errored or timed-out run counts as a failed check
    verdict = F.when(F.col("after_status") == "skipped", "unknown").when(ok_change & ok_tests & baseline & intact & new_test, "pass").otherwise("fail")
    return s.select("session_id", ok_change.alias("changes_ok"), ok_tests.alias("tests_ok"), baseline.alias("baseline_ok"), F.coalesce(intact, F.lit(True)).alias("intact_ok"),
                    "fixed", verdict.alias("verdict"))


def patch_targets(patches: DataFrame) -> DataFrame:
    """Files each unified diff touches and its strip level: (patch_id, strip, path)."""
    lines = tx.split_lines(F.col("text"))
    heads = F.filter(F.transform(lines, lambda s: F.when(s.startswith("--- ") | s.startswith("+++ "), s)), lambda s: s.isNotNull())
    clean = lambda s: F.regexp_replace(F.regexp_replace(tx.strip(F.substring(s, 5, 100000)), r"\t.*$", ""), r'^"(.*)"$', "$1")
    df = hold(patches.select("patch_id", "text"), h=heads)
    pairs = F.filter(F.transform("h", lambda s, i: F.when(s.startswith("+++ ") & F.coalesce(F.get("h", i - 1).startswith("--- "), F.lit(False)),
                                                          F.struct(clean(F.get("h", i - 1)).alias("old"), clean(s).alias("new")))), lambda p: p.isNotNull())
    df = hold(df, pairs=pairs)
    named = F.filter(F.flatten(F.transform("pairs", lambda p: F.array(p["old"], p["new"]))), lambda x: ~x.isin("", "/dev/null"))
    df = hold(df, strip=F.when((F.size(named) > 0) & F.forall(named, lambda x: x.rlike("^[ab]/")), 1).otherwise(0))
    chosen = F.filter(F.transform("pairs", lambda p: F.when(~p["new"].isin("", "/dev/null"), p["new"]).otherwise(p["old"])), lambda x: ~x.isin("", "/dev/null"))
    cut = F.transform(chosen, lambda x: F.when((F.col("strip") == 1) & x.contains("/"), F.regexp_replace(x, "^[^/]*/", "")).otherwise(x))
    return df.select("patch_id", "strip", F.explode(F.array_distinct(cut)).alias("path"))
