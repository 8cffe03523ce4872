"""Steps whose memory must not grow with the data."""

import re

from pyspark.sql import functions as F

from sourcegrain.operators import search as S
from sourcegrain.operators import similarity


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_needles_are_never_broadcast(spark):
    rows = spark.range(500).select(F.col("id").alias("passage_id"), F.concat(F.lit("checkEmail"), F.col("id").cast("string")).alias("content"))
    needles = spark.range(0, 1000, 2).select(F.col("id").alias("query_id"), F.concat(F.lit("checkEmail"), F.col("id").cast("string")).alias("needle"))
    runs = rows.select(F.col("content").alias("run"))
    assert "BroadcastHashJoin" not in _plan(S._within(runs, needles))
    assert S._within(runs.limit(5), needles).count() == 3  # checkEmail0, 2 and 4
    plans = needles.select("query_id", F.array("needle").alias("identifiers"))
    none = rows.select(F.lit(0).cast("long").alias("query_id"), "passage_id").where("false")
    found = S.identifier_candidates(rows, plans, none, None)
    assert "BroadcastHashJoin" not in _plan(found)
    assert found.where("query_id = 4").count() == 1 + 10 + 100  # 4, 40 to 49, 400 to 499


def test_quality_learns_from_every_label(spark):
    """Labelled documents that only a whole fit sees: the rarer kind of good text decides the weights."""
    import numpy as np
    import pytest
    quality = pytest.importorskip("sourcegrain.llm.quality")
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25_000, 16)).round(3)
    label = (x[:, 0] + rng.normal(size=len(x)) > 0.5).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "id long, features array<double>, label int")
    pairs = quality._pairs(rows, 0, int(label.sum())).cache()
    assert pairs.count() == quality.PAIRS * int((label == 0).sum())
    model = quality.fit(rows)
    assert abs(model.mean - x.mean(axis=0)).max() < 1e-6 and abs(model.scale - x.std(axis=0)).max() < 1e-5  # of all rows
    raw = np.sort(model.raw(x))
    bad = int((label == 0).sum())
    assert raw[bad - 1] <= model.threshold <= raw[bad]
    gap = np.array([r["gap"] for r in pairs.collect()]) / model.scale
    slope = -(gap / (1 + np.exp(gap @ model.weights))[:, None]).mean(axis=0) + 1e-3 * model.weights
    assert abs(slope).max() < 1e-6  # the least loss over all pairs
    assert (quality.fit(rows.repartition(3)).weights == model.weights).all()


def test_texts_are_not_dealt_by_term(spark):
    from sourcegrain.operators import triage as M
    text = "Login `run_job` broken\nValueError: bad run_job\nExpected: run_job (fine) in svc/a.py\nplain plain Plain run_job."
    issues = spark.createDataFrame([(1, text), (2, None), (1, text), (None, "alpha alpha"), (None, "alpha alpha")], "issue_id long, text string")
    terms = M.weighted_terms(issues, None)
    top = {r["term"]: r["weight"] for r in terms.where("issue_id = 1").collect()}
    # strongest kind, a quarter for each further mention up to 1.5, 1.5 in the title or an expected line
    assert top["run_job"] == 3.0 + 0.75 + 1.5 and top["svc/a.py"] == 3.0 + 1.5 and top["ValueError"] == 2.5 and top["Plain"] == 2.0 and top["plain"] == 1.0 + 0.25
    assert len(top) == terms.where("issue_id = 1").count()
    assert [r["weight"] for r in terms.where("issue_id IS NULL").collect()] == [1.0 + 0.25 + 1.5]
    dealt = [x for x in _plan(terms).split("\n") if "Aggregate" in x]
    assert dealt and not any("text" in x or "emphasis" in x for x in dealt)


def test_texts_are_split_once_a_line_scan(spark):
    """Splitting and trimming run once per file and line, and comments, blanks and hints are judged as by whole patterns."""
    from sourcegrain.functions import text as tx
    from sourcegrain.operators import rules as R
    from sourcegrain.sources.corpus import explode_lines, with_lines
    texts = ["a\r\nb\rc\n", "", "\n", "\r", "x\n\n", None, "\u00a0\n \t\x0b\f// eval(x)"]
    files = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    lines = explode_lines(with_lines(files))
    got = {}
    for r in lines.orderBy("path", "line_no").collect():
        got.setdefault(r.path, []).append(r.line)
    assert got == {"0": ["a", "b", "c"], "2": [""], "3": [""], "4": ["x", ""], "6": ["\u00a0", " \t\x0b\f// eval(x)"]}
    assert _plan(lines).count("split(") <= 1  # an inferred filter on the size would split again
    blank = lines.select((tx.lstrip(F.col("line")) != "").alias("a"), F.col("line").rlike(r"\S").alias("b"))
    assert blank.where("a <> b").count() == 0
    asked = [("javascript", " \f// eval(x)"), ("javascript", "eval(x)"), ("python", "eval(x)"), (None, "eval(x)"), (None, "'http://a.io'"), ("sql", "\t-- 'http://a.io'"),
             ("text", "jwt.decode(token)"), ("python", "# 'http://a.io'"), ("go", "# 'http://a.io'")]
    rows = spark.createDataFrame([("r", "f", i, s, "source", lang) for i, (lang, s) in enumerate(asked)], "repo_id string, path string, line_no int, line string, kind string, language string")
    hits = sorted((r.line_no, r.rule_id) for r in R.scan(rows).collect())
    assert hits == [(1, "unsafe-eval"), (2, "unsafe-eval-py"), (4, "insecure-http"), (8, "insecure-http")]


def test_sets_of_clones_travel_once(spark):
    docs = spark.range(40).select("id", F.expr("transform(sequence(1, 30), i -> concat('w', (i + id div 2 * 7) % 97, '.', i % 5))").alias("t"))
    reps, members = similarity.collapse(docs.select("id", F.size("t").alias("n_tokens"), similarity.shingles(F.col("t")).alias("shingles")))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def exchanged(df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        pairs = spark.createDataFrame([(0, 2), (2, 4)], "a long, b long")
        assert reps.count() == 20 and members.count() == 40
        # candidates go to the sets of their first side; these stay where they lie
        assert len(exchanged(reps.join(pairs, reps["rep"] == pairs["a"]))) == 2  # of the groups' names and of the pairs
        prefix = similarity._prefixes(reps, similarity.THRESHOLD)
        prefix.collect()
        dealt = prefix._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in dealt  # the shingles' counts and the join with them read one shuffle
        assert similarity.linked(reps).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_sieve_drops_only_rows_without_a_partner(spark):
    from sourcegrain.functions import sieve as V
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    words = spark.range(3000).select(F.col("id").cast("string").alias("w")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    left = {r.w for r in words.where(V.may_hold(V.sieve(keys, "k"), F.col("w"))).collect()}
    assert {str(i) for i in range(0, 3000, 3)} <= left and len(left) < 1050 and None not in left
    assert words.where(V.may_hold(V.sieve(keys.limit(0), "k"), F.col("w"))).count() == 0


def test_terms_are_counted_as_runs_of_word_characters(spark):
    """A term of word characters is looked up as a literal, once its text is cut into runs; others keep their pattern."""
    from sourcegrain.operators import triage as M
    text = "job\ntask task,task_a task\u00e9 -task- job-task job-task2 `job-task` xtask\nActual: job task.job"
    rows = {r["term"]: r["weight"] for r in M.weighted_terms(spark.createDataFrame([(1, text)], "issue_id long, text string"), None).collect()}
    for term, w in rows.items():
        found = len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", text, re.ASCII))
        shown = re.search(rf"(?<!\w){re.escape(term)}(?!\w)", "job job task.job", re.ASCII)
        assert w - min(1.5, 0.25 * (found - 1)) - (1.5 if shown else 0) in (1.0, 2.0, 2.5, 3.0), term
    assert {"job-task", "task_a", "task", "job"} <= set(rows)
    terms = M.weighted_terms(spark.createDataFrame([(1, text)], "issue_id long, text string"), None)
    assert _plan(terms).count("Exchange ") == 1  # dealt once, by issue; twice before


def test_words_of_code_are_sieved_before_they_are_dealt(spark):
    from sourcegrain.operators import triage as M
    terms = spark.createDataFrame([(1, "wanted", 2.0, 1)], "issue_id long, term string, weight double, rank int")
    signals = M.issue_signals(spark.createDataFrame([(1, "wanted")], "issue_id long, text string"))
    symbols = "array<struct<line_start:int,neg:int,ord:int,name:string,kind:string,line_end:int,parent:string,signature:string>>"
    parsed = spark.createDataFrame([("r", f"a{i}.py", "source", ["other wanted", "wanted" if i == 3 else "none"], []) for i in range(5)],
                                   f"repo_id string, path string, kind string, lines array<string>, symbols {symbols}")
    found = M.suspects(terms, signals, parsed)
    assert sum(r["score"] for r in found.collect()) == 5.0 and found.count() == 5
    assert "xxhash64(word" in _plan(found)


def test_facts_take_each_step_once(spark):
    """What a step works out is bound, not written out again wherever it is read."""
    from sourcegrain.operators import facts as C
    from sourcegrain.sources import corpus
    files = spark.createDataFrame([("r", "a.js", "source", "javascript", "router.get('/a', auth, check(x), find);\napp.post('/b', one, two);\n"
                                    "const go = (a) =>\n  a;\nexports.f = function (x) {\n};\nexport { a as b, c: d };")],
                                  "repo_id string, path string, kind string, language string, content string")
    parsed = C.parse(corpus.with_lines(files))
    r = parsed.collect()[0]
    assert [(x["middlewares"], x["handler"], x["path"]) for x in r["routes"]] == [([], "auth", "/a"), (["one"], "two", "/b")]
    assert [(x["name"], x["line_start"], x["line_end"]) for x in r["symbols"]] == [("go", 3, 4), ("f", 5, 6)]
    assert {"b", "d", "f"} <= set(r["exports"])
    plan = parsed.select("routes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position") == 1  # 14 where each reader had its own


def test_only_distinct_runs_of_a_chunk_leave_it(spark, monkeypatch):
    """Texts are dealt once; before, a row with its passage_id travelled for every run, and once more for every run with a term."""
    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("passage_id"), F.lit("a/b.py").alias("path"), F.concat(F.lit("login page of user "), "id").alias("content"))
    plans = S.plan(spark.createDataFrame([(1, "login user")], "query_id long, text string"))
    plans_of, kept = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df: (plans_of.append(_plan(df)), kept(df))[1])
    found = {(r.query_id, r.passage_id): round(r.score, 6) for r in S.substring_candidates(rows, plans).collect()}
    assert found == {(1, f"p{i}"): 1.6 for i in range(40)}
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", plans_of[-1])
    assert dealt and not any("passage_id" in x or "place" in x for x in dealt)
    assert "passage_id" not in " ".join(plans_of[:-1])
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"


def test_no_question_reads_no_passage(spark, monkeypatch):
    monkeypatch.setattr(S, "bucketed", lambda *a, **b: 1 / 0)
    rows = spark.createDataFrame([("a", "x.py", "user")], "passage_id string, path string, content string")
    plans = S.plan(spark.createDataFrame([(1, "user")], "query_id long, text string"))
    none = S.substring_candidates(rows, plans.where("false"))
    assert none.collect() == [] and none.columns == ["query_id", "passage_id", "score"]


def test_index_is_dealt_once_by_passage(spark, monkeypatch):
    """Texts travel, before they are cut; once each token of a passage travelled twice. Ids that repeat keep the old way."""
    rows = spark.createDataFrame([("a", "src/Ab.py", "x  alpha, alpha\u00e9 beta alpha"), ("b", None, "..."), ("c", "/", None)],
                                 "passage_id string, path string, content string")
    made = S.postings(rows, unique=True)
    dealt = re.findall(r"Exchange (\w+\([^)]*)", _plan(made))
    assert len(dealt) == 1 and "passage_id" in dealt[0] and "token" not in dealt[0]
    want = {("a", "x"): 1.0, ("a", "alpha"): 2.0, ("a", "alpha\u00e9"): 1.0, ("a", "beta"): 1.0, ("a", "src"): 3.0, ("a", "ab"): 3.0, ("a", "py"): 3.0}
    deals = []
    monkeypatch.setattr(S, "bucketed", lambda df, *a, kept=S.bucketed, **b: (deals.append(b["deal"]), kept(df, *a, **b))[1])
    for table, times in ((rows, 1), (rows.union(rows), 2)):
        held = S.build_index(table).postings.collect()
        assert {(r.passage_id, r.token): r.wtf for r in held} == {k: v * times for k, v in want.items()} and {r.dl for r in held} == {8}
    assert deals == [False, True]


def test_no_identifier_cuts_no_text(spark, monkeypatch):
    monkeypatch.setattr(S, "containing", lambda *a, **b: 1 / 0)
    rows = spark.createDataFrame([("a", "x.py", "user")], "passage_id string, path string, content string")
    plans = S.plan(spark.createDataFrame([(1, "user")], "query_id long, text string"))
    none = rows.select(F.lit(1).cast("long").alias("query_id"), "passage_id")
    found = S.identifier_candidates(rows, plans, none)
    assert found.collect() == [] and found.columns == ["query_id", "passage_id", "score"]


def test_compound_words_are_cut_once(spark):
    from sourcegrain.functions import identifiers as ids
    rows = spark.createDataFrame([("_a_b fooBar __x__ Foo fooBar FOO_BAR bazQux",)], "t string").select(ids.expand_terms(F.col("t")).alias("x"))
    assert rows.collect()[0]["x"] == ["foo", "bar", "baz", "qux"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_python_blocks_by_brackets_and_indent(spark):
    """Lines are measured without patterns; a signature that ends on its first line measures no other line."""
    from sourcegrain.operators import facts as C
    from sourcegrain.sources import corpus
    text = ("class A:  # (\n    def f(self,\n          x):\n\n        # ) note\n        return [x]\n\n# out\n    def g(self): return 1\n"
            "def h(a):\n\treturn {\n\t  1: 2}\n   \nx = 1\n")
    files = spark.createDataFrame([("r", "a.py", "source", "python", text)], "repo_id string, path string, kind string, language string, content string")
    parsed = C.parse(corpus.with_lines(files), "symbols")
    assert [(x["name"], x["line_start"], x["line_end"], x["parent"]) for x in parsed.collect()[0]["symbols"]] == [
        ("A", 1, 9, None), ("f", 2, 8, "A"), ("g", 9, 9, "A"), ("h", 10, 12, None)]
    assert r"[^(\[{]" not in parsed._jdf.queryExecution().optimizedPlan().toString()
