"""Operators on small literal fixtures, against expected values or brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.identifiers import is_compound, split_identifier
from sourcegrain.functions.ranking import number_rows
from sourcegrain.operators import facts as C
from sourcegrain.operators import flows as W
from sourcegrain.operators import rules as R
from sourcegrain.operators import search as S
from sourcegrain.operators import similarity as SIM
from sourcegrain.operators import verify as V
from sourcegrain.sources.corpus import with_lines
from sourcegrain.sources.listing import classify


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_line_endings(spark):
    assert one(spark, tx.split_lines(F.col("t")), t="a\r\nb\rc\nd\n") == ["a", "b", "c", "d"]
    assert one(spark, tx.split_lines(F.col("t")), t="") == []
    assert one(spark, tx.split_lines(F.col("t")), t="a\n\n") == ["a", ""]


def test_range_hash_ignores_trailing_blanks(spark):
    want = hashlib.sha256(b"a\nb").hexdigest()
    assert one(spark, tx.hash_range(tx.split_lines(F.col("t")), F.lit(1), F.lit(2)), t="a \t\nb  \nc") == want


def test_decode_replaces_bad_bytes(spark):
    assert one(spark, tx.decode_source(F.col("b")), b=bytearray(b"\xef\xbb\xbfa\xffb")) == "a�b"


def test_identifiers(spark):
    cases = {"findUserByEmail": ["find", "user", "by", "email"], "API_KEY": ["api", "key"], "postJSON": ["post", "json"]}
    for name, parts in cases.items():
        assert one(spark, split_identifier(F.col("t")), t=name) == parts
        assert one(spark, is_compound(F.col("t")), t=name)
    for name in ("plain", "UPPER", "_x", "Word"):
        assert not one(spark, is_compound(F.col("t")), t=name)


def scan(spark, *lines, language="javascript", kind="source", cap=None):
    rows = [("r", "f", i, s, kind, language) for i, s in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "repo_id string, path string, line_no int, line string, kind string, language string")
    return sorted((r.line_no, r.rule_id) for r in R.scan(df, cap=cap).collect())


def test_rules_hit_and_miss(spark):
    hits = scan(spark, 'const password = "hunter2-x";', 'const api_key = "${VALUE}";', 'const url = "http://localhost/x";', "el.innerHTML = 'static';",
                "el.innerHTML = value;", 'const q = "SELECT * FROM t WHERE a = \'" + a;', "// eval(x)", "eval(x)", "x.eval(y)", 'token = "##RETRY##"')
    assert hits == [(1, "hardcoded-secret"), (5, "dom-xss"), (6, "sql-injection"), (8, "unsafe-eval")]


def test_rule_cap_and_mask(spark):
    lines = [f'const token = "abc{i}defg-1";' for i in range(9)]
    assert len(scan(spark, *lines)) == 9
    assert scan(spark, *lines, cap=5) == [(i, "hardcoded-secret") for i in range(1, 6)]
    assert scan(spark, "x" * 5000 + "; " + lines[0]) == [(1, "hardcoded-secret")]
    df = spark.createDataFrame([("r", "f", 1, lines[0], "source", "javascript")], "repo_id string, path string, line_no int, line string, kind string, language string")
    assert R.scan(df).first()["evidence"] == 'const token = "abc0[REDACTED]";'


def test_family_scans_equal_single_pass(spark):
    rows = [("r", "f", i, s, "source", "javascript") for i, s in enumerate(["eval(x)", "cors()", "Math.random()", "const sessionId = Math.random()", 'a = "http://x.io/y"'], 1)]
    df = spark.createDataFrame(rows, "repo_id string, path string, line_no int, line string, kind string, language string")
    whole = {(r.line_no, r.rule_id) for r in R.scan(df).collect()}
    parts = {(r.line_no, r.rule_id) for s in R.SCANNER_FAMILIES for r in R.scan(df, R.rules_of(s)).collect()}
    assert whole == parts and whole


def parse(spark, **files):
    df = spark.createDataFrame([("r", p.replace("__", "/").replace("_dot_", "."), t) for p, t in files.items()], "repo_id string, path string, content string")
    return C.parse(classify(with_lines(df)))


def test_python_symbols_and_routes(spark):
    code = "@app.get('/x')\ndef show(\n    a,\n):\n    return a\n# note\n    # inside\n\nclass A(B):\n    def run(self):\n        def inner(): pass\n        return 1\n"
    row = parse(spark, m_dot_py=code).first()
    assert [(s.name, s.kind, s.line_start, s.line_end, s.parent) for s in row.symbols] == [
        ("show", "function", 2, 7, None), ("A", "class", 9, 12, None), ("run", "method", 10, 12, "A"), ("inner", "method", 11, 11, "A")]
    assert [(r.method, r.path, r.handler) for r in row.routes] == [("GET", "/x", "show")]


def test_js_blocks_ignore_strings_comments_templates(spark):
    code = "function a() {\n  const s = '}';\n  // }\n  /* }\n  } */\n  return `}${x ? '}' : `{`}`;\n}\nconst b = (x) =>\n  x + 1;\nrouter.get('/p/:id', auth, (req, res) => {\n  res.json({});\n});\n"
    row = parse(spark, m_dot_js=code).first()
    assert [(s.name, s.line_start, s.line_end) for s in row.symbols] == [("a", 1, 7), ("b", 8, 9)]
    assert [(r.path, r.line_end, list(r.middlewares), r.handler) for r in row.routes] == [("/p/:id", 12, ["auth"], None)]


def test_traces_of_routes_of_any_handler(spark, monkeypatch):
    from sourcegrain.plans import graph
    js = "function list(req, res) {\n  res.json({});\n}\nrouter.get('/a', list);\nrouter.post('/b', requireAuth, (req, res) => {\n  res.json({});\n});\n"
    files = parse(spark, m_dot_js=js, n_dot_py="@app.get('/x')\ndef show():\n    return 1\n")
    monkeypatch.setattr(graph, "fact_table", lambda *_: files)
    got = {(r.path, r.line, r.layer, r.label) for r in graph.backend_traces_all(spark, None).collect()}
    assert got == {("m.js", 4, "Route", "GET /a"), ("m.js", 5, "Route", "POST /b"), ("m.js", 5, "Auth", "requireAuth() middleware"), ("n.py", 1, "Route", "GET /x"),
                   ("m.js", 4, "Service", "list()"), ("n.py", 1, "Service", "show()")}


def test_route_matching_against_brute_force(spark):
    rng = random.Random(3)
    seg = lambda: rng.choice(["a", "b", ":id", "c"])
    calls = {(rng.choice(["GET", "POST"]), "/" + "/".join(rng.choice(["a", "b", "c", "${x}"]) for _ in range(rng.randint(0, 3)))) for _ in range(40)}
    routes = [(i, rng.choice(["GET", "POST", "ALL"]), "/" + "/".join(seg() for _ in range(rng.randint(0, 3)))) for i in range(25)]
    import re
    parts = lambda p: [s for s in re.sub(r"\$\{[^}]+\}|:\w+", "*", p).strip("/").split("/") if s]
    same = lambda a, b: len(a) == len(b) and all(x == y or "*" in (x, y) for x, y in zip(a, b))
    want = {}
    for method, target in calls:
        t = parts(target)
        exact = [r for r in routes if same(t, parts(r[2]))]
        pick = next((r for r in exact if r[1] in (method, "ALL")), None) or (exact[0] if exact else None) or next(
            (r for r in routes if parts(r[2]) and same(t[-len(parts(r[2])):], parts(r[2]))), None)
        if pick:
            want[(method, target)] = pick[0]
    c = spark.createDataFrame([("r", m, t) for m, t in calls], "repo_id string, method string, target string")
    r = spark.createDataFrame([("r", "f", i, i, m, p) for i, m, p in routes], "repo_id string, path string, ordinal int, line int, method string, route_path string")
    got = {(x.method, x.target): x.route_line for x in W.match_routes(c, r).collect()}
    assert got == want and len(want) > 10


def test_similarity_join_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(40)] for _ in range(12)]
    docs = []
    for tokens in base:
        for _ in range(5):
            t = list(tokens)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 5)}"
            docs.append(t)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in docs]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t array<string>")
    items = df.select("id", F.size("t").alias("n_tokens"), SIM.shingles(F.col("t")).alias("shingles"))
    reps, members = SIM.collapse(items)
    rep_of = {r.id: r.rep for r in members.collect()}
    got = {(r.rep_a, r.rep_b): r.score for r in SIM.similar_pairs(reps).collect()}
    names = sorted(set(rep_of.values()))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in names for b in names if a < b}
    want = {k: v for k, v in want.items() if v >= SIM.THRESHOLD}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    root = {n: n for n in names}
    for _ in names:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.rep: r.cluster for r in SIM.linked(reps).collect()} == root
    sizes = [sum(root[rep_of[i]] == c for i in rep_of) for c in names]
    placed = {r.id: r.cluster for r in SIM.memberships(reps, members).collect()}
    assert placed == {i: root[r] for i, r in rep_of.items() if sizes[names.index(root[r])] >= 2}
    assert SIM.linked(reps.limit(0)).collect() == []


def test_short_documents_have_clones(spark, tmp_path):
    from sourcegrain.plans import clones
    long = " ".join(f"w{i}" for i in range(30))
    texts = ["one two three", "One, two three!", "one two four", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "!!!", "???", None, long, long]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.id, r.cluster) for r in clones.cluster_members_all(spark, str(tmp_path)).collect()} == {(0, 0), (1, 0), (3, 3), (4, 3), (8, 8), (9, 8)}
    assert {(r.rep_a, r.rep_b) for r in clones.similar_document_pairs_all(spark, str(tmp_path)).collect()} == {(3, 4)}
    assert {(r.id, r.cluster) for r in clones.cluster_members(spark, str(tmp_path)).collect()} == {(8, 8), (9, 8)}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, i) for i in range(101, 180)]
    nodes = spark.range(0, 200).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in SIM.components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(71)) and all(got[i] == 100 for i in range(100, 180)) and got[90] == 90


def test_number_rows(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).cast("string").alias("repo_id"), (999 - F.col("id")).alias("v"))
    got = number_rows(df, [F.col("v").asc()], "n", per="repo_id").collect()
    for key in ("0", "1", "2"):
        rows = sorted((r.v, r.n) for r in got if r.repo_id == key)
        assert [n for _, n in rows] == list(range(1, len(rows) + 1))


def test_evidence_states(spark):
    files = with_lines(spark.createDataFrame([("r", "a.js", "one\nalpha  beta\nthree three\n")], "repo_id string, path string, content string"))
    claims = [("ok", "a.js", 2, "alpha beta"), ("moved", "a.js", 1, "three three"), ("gone", "b.js", 1, "x"), ("range", "a.js", 99, None),
              ("invented", "a.js", 1, "never written"), ("unsafe", "../a.js", 1, "one"), ("masked", "a.js", 2, "al[REDACTED]ta…")]
    df = spark.createDataFrame([("r", *c, None, None) for c in claims], "repo_id string, id string, path string, line int, evidence string, line_end int, indexed_sha256 string")
    got = {r.id: (r.status, r.line) for r in V.anchor(df, files).collect()}
    assert got == {"ok": ("verified", 2), "moved": ("verified", 3), "gone": ("missing", 1), "range": ("invalid_line", 99), "invented": ("unsupported", 1),
                   "unsafe": ("unsafe_path", 1), "masked": ("verified", 2)}


def test_containing_against_brute_force(spark):
    texts = ["findUserByEmail(x)", "a_b zeta", "étude tok", "xx yy", "tokenize token_a"]
    needles = ["tok", "a_b", "User", "y", "token_a", "nothing"]
    ps = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "passage_id string, content string")
    ns = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {(r.needle, int(r.passage_id)) for r in S.containing(ps, ns, lower=False).collect()}
    assert got == {(n, i) for n in needles for i, t in enumerate(texts) if n in t}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_needles_that_begin_alike_meet_runs_as_wholes(spark):
    # once each run met every needle of its first three characters and was then tested by contains
    runs = [f"checkEmail{i}" for i in range(40)]
    ps = spark.createDataFrame([(str(i), f"{r}(x)") for i, r in enumerate(runs)], "passage_id string, content string")
    found = S.containing(ps, spark.createDataFrame([(r,) for r in runs], "needle string"), lower=False)
    assert {(r.needle, int(r.passage_id)) for r in found.collect()} == {(n, i) for n in runs for i, r in enumerate(runs) if n in r}
    plan = _plan(found)
    assert "Contains(" not in plan and "strategy=merge" in plan  # the exploded runs are not broadcast either


def test_substring_candidates_against_brute_force(spark):
    passages = [("a", "src/find.py", "find_user findUser user users USER user user user"), ("b", "src/x.py", "nothing here"), ("c", "doc/user.md", None),
                ("d", "one.py", "login page"), ("d", "one.py", "token of a page"), ("d", "one.py", "login page"), ("e", "y", "finduser_ __"), (None, "user", "user")]
    asked = [(1, "find_user"), (2, "login user"), (3, "zzz"), (4, None), (5, "token"), (5, "token"), (5, "login page"), (None, "user")]
    plans = S.plan(spark.createDataFrame(asked, "query_id long, text string"))
    got = sorted((r.query_id, r.passage_id, round(r.score, 6)) for r in S.substring_candidates(
        spark.createDataFrame(passages, "passage_id string, path string, content string"), plans).collect())
    terms = [(r.query_id, list(dict.fromkeys([*r.terms, *r.expanded]))[:10]) for r in plans.collect() if r.query_id is not None]
    want = []
    for q, ts in terms:
        needles = [t.replace("_", "") for k, other in terms if k == q for t in other if t.replace("_", "")]
        ids = {p for p, path, c in passages if any(n in (c or "").lower() or n in path for n in needles)}
        want += [(q, p, round(0.8 * sum(min((c or "").lower().count(t), 5) for t in ts), 6)) for p, _, c in passages if p in ids and p is not None]
    assert got == sorted(want) and len(want) > 15


def _plain_bm25(passages, queries, limit, scope):
    """(query, passage): score by the formula, every term against every token."""
    tokens = {p: [(t, 1.0) for t in re.findall(r"[a-z0-9]+", c.lower())] + [(t, 3.0) for t in re.findall(r"[a-z0-9]+", path)] for p, path, c, _, _ in passages}
    tokens = {p: t for p, t in tokens.items() if t}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, terms in queries.items():
        scores = collections.Counter()
        for term in terms:
            tf = {p: sum(w for t, w in ts if (t.startswith(term) if len(term) >= 3 else t == term)) for p, ts in tokens.items()}
            tf = {p: f for p, f in tf.items() if f}
            idf = math.log((len(tokens) - len(tf) + 0.5) / (len(tf) + 0.5))
            for p, f in tf.items():
                scores[p] += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens[p]) / mean))
        seen = {p for p, _, _, repo, kind in passages if q not in scope or (scope[q][0] in (None, repo) and (scope[q][1] is None or kind in scope[q][1]))}
        best = sorted((-round(s, 9), p, s) for p, s in scores.items() if p in seen)[:limit]
        out |= {(q, p): s for _, p, s in best}
    return out


@pytest.mark.parametrize("limit", [3, 1000])
def test_index_search_against_plain_scores(spark, limit):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("alpha", "alp", "beta", "be", "gam", "gamma") for b in ("", "x", "xy", "1")] + ["tail"]
    passages = [(f"p{i:03d}", "src/mod.py" if i % 5 else "zeta/alpha.py", " ".join(rng.choices(words, k=rng.randint(0, 30)) + ["shared"] * (i % 4 > 0)), f"r{i % 3}", "code" if i % 2 else "doc")
                for i in range(90)] + [("p900", "", "...", "r0", "doc")]
    asked = {1: "alpha shared", 2: "shared src", 3: "gamma tail be", 4: "zeta shared", 5: "nothing", 6: "alp beta shared src mod", 7: "shared"}
    scope = {2: ("r1", None), 3: (None, ["doc"]), 6: ("r2", ["code"]), 5: ("r9", None)}
    rows = spark.createDataFrame([(*p, 1) for p in passages], "passage_id string, path string, content string, repo_id string, memory_type string, dl int").drop("dl")
    index = S.build_index(rows)
    plans = S.plan(spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    limits = spark.createDataFrame([(q, *x) for q, x in scope.items()], "query_id long, repo_id string, memory_types array<string>")
    terms = {q: {t for t in r.terms + r.expanded} for q, r in ((r.query_id, r) for r in plans.collect())}
    got = {(r.query_id, r.passage_id): r.score for r in S.bm25(index, plans, limit, limits).collect()}
    want = _plain_bm25(passages, terms, limit, scope)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 10
    every = {(r.query_id, r.passage_id) for r in S.bm25(index, plans, None, limits).collect()}
    assert every == _plain_bm25(passages, terms, None, scope).keys()


def test_index_is_added_up_where_it_lies(spark):
    # pairs of query and passage were once shuffled before the limit; now only each task's first rows of a query are
    rows = spark.createDataFrame([(f"p{i}", "a.py", "alpha beta " * (i % 3 + 1)) for i in range(20)], "passage_id string, path string, content string")
    found = S.bm25(S.build_index(rows), S.plan(spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id long, text string")), 5)
    assert len(found.collect()) == 10
    assert not re.search(r"hashpartitioning\([^)]*passage_id", found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString())


def test_index_of_nothing(spark):
    rows = spark.createDataFrame([("a", "", None)], "passage_id string, path string, content string")
    plans = S.plan(spark.createDataFrame([(1, "alpha"), (2, None), (3, "")], "query_id long, text string"))
    assert S.bm25(S.build_index(rows), plans).collect() == []


def test_findings_matched_one_to_one_across_snapshots(spark):
    from sourcegrain.operators import findings as K
    from sourcegrain.plans.findings import snapshot_findings
    schema = "repo_id string, path string, kind string, language string, lines array<string>, sha256 string"
    eval_line, key_line = "eval(input)", "const password = 'hunter2secret99';"
    before = [("r", "a.js", [eval_line, "x", eval_line, key_line]), ("r", "b.js", [eval_line]), ("r", "c.js", []), ("r", "d.js", None)]
    after = [("r", "a.js", ["header", eval_line, key_line, key_line]), ("r", "c.js", [eval_line]), ("s", "a.js", [eval_line])]

    def found(files):
        rows = [(r, p, "source", "javascript", lines, "h") for r, p, lines in files]
        return snapshot_findings(spark.createDataFrame(rows, schema)).withColumn("analysis_order", F.struct("line", "rule_order"))

    old, new = found(before), found(after)
    got = {(r.repo_id, r.path, r.old_line, r.line, r.state) for r in K.occurrence_lifecycle(old, new).collect()}
    assert got == {("r", "a.js", 1, 2, "unchanged"), ("r", "a.js", 3, None, "resolved"), ("r", "a.js", 4, 3, "unchanged"), ("r", "a.js", None, 4, "new"),
                   ("r", "b.js", 1, None, "resolved"), ("r", "c.js", None, 1, "new"), ("s", "a.js", None, 1, "first")}
    states = sorted((r.repo_id, r.state) for r in K.lifecycle(old, new).collect())
    assert states == [("r", "new"), ("r", "resolved"), ("r", "unchanged"), ("r", "unchanged"), ("r", "unchanged"), ("s", "first")]
    assert K.occurrence_lifecycle(old.where("false"), new.where("false")).count() == 0


def test_citations_against_brute_force(spark):
    import hashlib
    import random
    rng = random.Random(5)
    texts = {f"f{k}": [rng.choice(["a ", "b", "\tc", "", "d  e"]) for _ in range(rng.randint(0, 12))] for k in range(8)}

    def sha(lines):
        return hashlib.sha256("\n".join(x.rstrip() for x in lines).encode()).hexdigest()
    files = spark.createDataFrame([("r", p, x, sha(x)) for p, x in texts.items()] + [("r", "null", None, None)],
                                  "repo_id string, path string, lines array<string>, sha256 string")
    cites = []
    for k in range(600):
        path = rng.choice([*texts, "f0", "f0", "gone", "null", None, "../f1"])
        start, span, source = rng.randint(1, 13), rng.randint(1, 4), rng.choice([*texts.values()])
        at = rng.randint(0, 8)
        cites.append((k, "r", path, start, rng.choice([start + span - 1, None]), rng.choice([sha(source[at:at + span]), sha(source[at:at + 1]), "", None]), None))
    df = spark.createDataFrame(cites, "k int, repo_id string, path string, line_start int, line_end int, evidence_sha256 string, file_sha256 string")
    got = {r.k: (r.status, r.relocated_line) for r in V.verify(df, files).collect()}

    def plain(path, start, end, expected):
        if path is not None and path.startswith(".."):
            return "unsafe_path", None
        lines = texts.get(path)
        if lines is None:
            return "missing", None
        end = max(end or start, start)
        expected = expected or ""
        if start <= len(lines) and (not expected or sha(lines[start - 1:end]) == expected):
            return "verified", None
        spans = [i + 1 for i in range(len(lines) - (end - start)) if expected and sha(lines[i:i + end - start + 1]) == expected]
        return "stale", spans[0] if spans else None
    want = {k: plain(p, s, e, h) for k, _, p, s, e, h, _ in cites}
    assert got == want and {"verified", "stale", "missing", "unsafe_path"} == {s for s, _ in want.values()} and any(m for _, m in want.values())
    assert V.verify(df.where("false"), files).count() == 0
