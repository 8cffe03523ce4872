"""Issue and test-outcome queries. Issues are conversation turns with planted names; logs come from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import triage as M
from sourcegrain.plans.facts import fact_table
from sourcegrain.plans.oracle import CODE, DOCS, NEXT_DOCS, ctes
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import q
from sourcegrain.plans import inputs
from sourcegrain.session import stored
from sourcegrain.sources import tables
from sourcegrain.sources.corpus import _run, table

_TEXT = """concat('checkEmail', k, ' rejects valid input', chr(10), 'ValueError: bad code ', k, chr(10), 'File "svc/handler_', k, '.py", line 18', chr(10),
 'Expected: `checkEmail', k, '` accepts it', chr(10), 'Actual: it is rejected by lib/mod_', k, '.js', chr(10), '1. run test_login_', k, chr(10), text)"""
_ISSUES = f"SELECT conv_id * 1000 + turn AS issue_id, {_TEXT} AS text FROM (SELECT conv_id, turn, text, CAST((conv_id * 6) % 180 AS STRING) AS k FROM conversations)"


def issues(spark, sf_dir):
    return _run(spark, sf_dir, "conversations", _ISSUES)


@query("weighted_terms", "M1", None)
def weighted_terms(spark, sf_dir):
    return M.weighted_terms(issues(spark, sf_dir))


@query("issue_signals", "M2", f"""WITH i AS (SELECT *, CAST((issue_id // 1000 * 6) % 180 AS VARCHAR) AS k, concat(' ', lower(text), ' ') AS low FROM ({_ISSUES}))
 SELECT issue_id, array_to_string(list_filter([{', '.join("CASE WHEN " + " OR ".join(f"contains(low, {q(w)})" for w in ws) + f" THEN '{n}' END" for n, ws in M.KINDS.items())}],
 lambda x: x IS NOT NULL), ',') AS kinds, concat('svc/handler_', k, '.py:18') AS frames, concat('checkEmail', k) AS expected_name, concat('test_login_', k) AS test_names FROM i""")
def issue_signals(spark, sf_dir):
    s = M.issue_signals(issues(spark, sf_dir))
    return s.select("issue_id", F.array_join("kinds", ",").alias("kinds"), F.element_at("frames", 1).alias("frames"),
                    F.regexp_extract(F.element_at("expected", 1), "`(.*?)`", 1).alias("expected_name"), F.element_at("test_names", 1).alias("test_names"))


def _suspects(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    i = issues(spark, sf_dir)
    signals = stored(M.issue_signals(i))
    return p, signals, stored(M.suspects(stored(M.weighted_terms(i)), signals, p))


@query("suspect_ranking", "M3", None)
def suspect_ranking(spark, sf_dir):
    return _suspects(spark, sf_dir)[2]


@query("covering_tests", "M6", None)
def covering_tests(spark, sf_dir):
    p, _, s = _suspects(spark, sf_dir)
    return M.covering_tests(p, s.where("rank <= 3"))


@query("plan_steps", "M7", None)
def plan_steps(spark, sf_dir):
    _, signals, s = _suspects(spark, sf_dir)
    return M.plan_steps(s, signals)


_FAIL = """SELECT event_id AS run_id, concat('> assert price_total(x) == ', CAST(event_id AS STRING), chr(10), 'E  + where 5 = apply_discount(order)', chr(10), 'plain line') AS text FROM events"""


@query("failure_signals", "M4", """SELECT event_id AS run_id, name, w::DOUBLE AS weight FROM events, (SELECT unnest(['price_total', 'apply_discount']) AS name, unnest([1.5, 3.0]) AS w) t""")
def failure_signals(spark, sf_dir):
    return M.failure_signals(_run(spark, sf_dir, "events", _FAIL))


@query("rerank_suspects", "M5", """WITH s AS (SELECT event_id AS run_id, unnest(['apply_discount', 'other', 'price_total']) AS symbol, unnest([1.0, 3.5, 2.2]) AS score FROM events)
 SELECT run_id, symbol, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, symbol) AS rank FROM (SELECT run_id, symbol,
 round(score + CASE symbol WHEN 'apply_discount' THEN 3.0 WHEN 'price_total' THEN 1.5 ELSE 0 END, 2)::DOUBLE AS score FROM s)""")
def rerank_suspects(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(n).alias("symbol"), F.lit(s).alias("score")) for n, s in (("apply_discount", 1.0), ("other", 3.5), ("price_total", 2.2))])
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.explode(rows).alias("x")).select("run_id", "x.*", F.col("x.symbol").alias("path"), F.lit(1).alias("line_start"))
    return M.rerank(found, M.failure_signals(_run(spark, sf_dir, "events", _FAIL))).select("run_id", "symbol", "score", "rank")


# One log per event; runner and counts follow the event id.
_LOGS = """SELECT event_id AS run_id, CASE event_id % 6 WHEN 0 THEN 'pytest' WHEN 1 THEN 'unittest' WHEN 2 THEN 'npm' WHEN 3 THEN 'npm' WHEN 4 THEN 'go' ELSE 'cargo' END AS runner,
 CAST(event_id % 3 AS INT) AS exit_code, CASE event_id % 6
 WHEN 0 THEN concat('FAILED tests/test_a.py::test_', n, chr(10), 'ERROR tests/test_b.py', chr(10), '== ', n, ' failed, 7 passed, 1 skipped, 2 errors, 1 xfailed ==')
 WHEN 1 THEN concat('FAIL: test_', n, ' (x)', chr(10), 'Ran 20 tests in 1s', chr(10), 'FAILED (failures=2, errors=1, skipped=3)')
 WHEN 2 THEN concat('  ✕ shows ', n, chr(10), 'Tests:       1 failed, 2 skipped, ', n, ' passed, 9 total')
 WHEN 3 THEN concat('  ', n, ' passing', chr(10), '  2 failing', chr(10), 'not ok 3 - case ', n)
 WHEN 4 THEN concat('--- FAIL: Test', n, ' (0.0s)', chr(10), '--- FAIL: TestB (0.0s)', chr(10), 'FAIL')
 ELSE concat('test result: FAILED. ', n, ' passed; 1 failed; 2 ignored', chr(10), 'failures:', chr(10), '    mod::t', n, chr(10), 'test result: ok. 1 passed; 0 failed; 0 ignored') END AS text
 FROM (SELECT event_id, CAST(event_id % 50 AS STRING) AS n FROM events)"""


@query("parse_test_logs", "M8", """WITH e AS (SELECT event_id AS run_id, event_id % 6 AS m, (event_id % 50)::INT AS n FROM events)
 SELECT run_id, CASE m WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN n WHEN 3 THEN n WHEN 5 THEN n + 1 END::INT AS passed, CASE m WHEN 0 THEN n WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 1 END::INT AS failed,
 CASE m WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 5 THEN 2 END::INT AS skipped, CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS errors,
 CASE m WHEN 0 THEN concat('tests/test_a.py::test_', n, ',tests/test_b.py') WHEN 1 THEN concat('test_', n) WHEN 2 THEN concat('shows ', n) WHEN 3 THEN concat('case ', n)
  WHEN 4 THEN concat('Test', n, ',TestB') ELSE concat('mod::t', n) END AS failing FROM e""")
def parse_test_logs(spark, sf_dir):
    return M.parse_logs(_run(spark, sf_dir, "events", _LOGS)).select("run_id", "passed", "failed", "skipped", "errors", F.array_join("failing", ",").alias("failing"))


@query("test_outcomes", "M9", """SELECT CASE WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 3 = 0 THEN 'passed' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1""")
def test_outcomes(spark, sf_dir):
    p = M.parse_logs(_run(spark, sf_dir, "events", _LOGS))
    status = M.outcome(F.col("exit_code"), F.col("failed"), F.col("errors"), F.size("failing"), F.col("run_id") % 7 == 0)
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("snapshot_diff", "M10", ctes(DOCS, NEXT_DOCS) + """SELECT repo_id, path, CASE WHEN d.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'edited' END AS change
 FROM docs d FULL JOIN next_docs n USING (repo_id, path) WHERE d.sha256 IS DISTINCT FROM n.sha256""")
def snapshot_diff(spark, sf_dir):
    return tables.snapshot_diff(inputs.docs(spark, sf_dir).select("repo_id", "path", "sha256"), inputs.next_docs(spark, sf_dir).select("repo_id", "path", "sha256"))


@query("test_path_classes", "M11", ctes(CODE) + "SELECT repo_id, path, path LIKE 'tests/%' AS is_test FROM code")
def test_path_classes(spark, sf_dir):
    return M.test_paths(inputs.code(spark, sf_dir).select("repo_id", "path"))


@query("gate_verdicts", "M12", """WITH e AS (SELECT event_id AS session_id, event_id % 3 AS b, event_id % 4 AS a, event_id % 5 AS c FROM events)
 SELECT session_id, CASE WHEN a = 3 THEN 'unknown' WHEN c > 0 AND a = 0 AND (b = 0 OR c >= 2) AND NOT (b = 0 AND c = 3) THEN 'pass' ELSE 'fail' END AS verdict FROM e""")
def gate_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("session_id"))
    sid = F.col("session_id")
    sessions = e.select("session_id", F.when(sid % 3 == 0, "failed").otherwise("passed").alias("before_status"),
                        F.when(sid % 4 == 0, "passed").when(sid % 4 == 3, "skipped").otherwise("failed").alias("after_status"))
    before = e.where("session_id % 3 = 0").select("session_id", F.lit("before").alias("phase"), F.lit("tests/test_a.py::test_x").alias("test_id"), F.lit("failed").alias("outcome"))
    after = e.where("session_id % 4 IN (1, 2)").select("session_id", F.lit("after").alias("phase"), F.lit("tests/test_a.py::test_x").alias("test_id"), F.lit("failed").alias("outcome"))
    c = sid % 5
    # 0: nothing changed, 1: source only, 2 and 4: another test, 3: the failing test itself
    path = F.when(c == 1, "src/a.py").when(c == 3, "tests/test_a.py").otherwise("tests/test_new.py")
    changes = e.where("session_id % 5 > 0").select("session_id", path.alias("path"), (c >= 2).alias("is_test"))
    return M.gate(sessions, before.unionByName(after), changes).select("session_id", "verdict")


_PATCHES = """SELECT p_partkey AS patch_id, CASE p_partkey % 3 WHEN 0 THEN concat('diff --git a/x b/x', chr(10), '--- a/src/m', n, '.js', chr(10), '+++ b/src/m', n, '.js', chr(10), '@@ -1 +1 @@', chr(10), '-a', chr(10), '+b')
 WHEN 1 THEN concat('--- src/m', n, '.js', chr(9), '2024-01-01', chr(10), '+++ src/m', n, '.js', chr(9), '2024-01-02', chr(10), '+x')
 ELSE concat('--- a/old', n, '.py', chr(10), '+++ /dev/null', chr(10), '--- /dev/null', chr(10), '+++ b/new', n, '.py') END AS text FROM (SELECT p_partkey, CAST(p_partkey AS STRING) AS n FROM part)"""


@query("patch_targets", "M13", """SELECT p_partkey AS patch_id, CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS strip, unnest(CASE WHEN p_partkey % 3 = 2 THEN [concat('old', p_partkey, '.py'), concat('new', p_partkey, '.py')]
 ELSE [concat('src/m', p_partkey, '.js')] END) AS path FROM part""")
def patch_targets(spark, sf_dir):
    return M.patch_targets(_run(spark, sf_dir, "part", _PATCHES))


