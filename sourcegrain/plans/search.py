"""Retrieval queries: benchmark texts searched in the document passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import passages as P
from sourcegrain.operators import routing as T
from sourcegrain.operators import search as S
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, DOCS, ctes
from sourcegrain.plans.passages import windows_cte
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import q
from sourcegrain.session import stored
from sourcegrain.sources.corpus import spread, table

# Query texts: each benchmark item, some with a keyword or an identifier added.
_QUERIES = """qs AS (SELECT item_id AS query_id, concat(CASE item_id % 4 WHEN 0 THEN 'Where is the login of ' WHEN 1 THEN 'findUserByEmail ' WHEN 2 THEN 'how does it '
 ELSE 'where is it ' END, text) AS text FROM benchmark)"""


def queries(spark, sf_dir):
    m = F.col("item_id") % 4
    lead = F.when(m == 0, "Where is the login of ").when(m == 1, "findUserByEmail ").when(m == 2, "how does it ").otherwise("where is it ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(lead, "text").alias("text"))


_STOP = "[" + ", ".join(q(w) for w in S.STOPWORDS) + "]"
_SYN = "(SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(w)}, {i})" for k, v in S.SYNONYMS.items() for i, w in enumerate(v)) + ") t(k, w, i))"
_C = "trim(x, '_')"
_CMP = f"(strpos({_C}, '_') > 0 OR (regexp_matches({_C}, '[A-Z]') AND regexp_matches({_C}, '[a-z]') AND regexp_matches(substr({_C}, 2), '[A-Z]')))"
_SPLIT = (r"list_transform(regexp_extract_all(regexp_replace(replace(x, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\d+'), lambda p: lower(p))")
PLAN = f"""qw AS (SELECT query_id, trim(text) AS raw, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS x, unnest(range(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + 1)) AS i FROM qs),
 qt AS (SELECT query_id, i, 0 AS j, lower(x) AS term FROM qw WHERE {_CMP} OR (length(x) > 1 AND NOT list_contains({_STOP}, lower(x)))
  UNION ALL SELECT query_id, i, unnest(range(1, len({_SPLIT}) + 1)), unnest({_SPLIT}) FROM qw WHERE {_CMP}),
 qd AS (SELECT query_id, term, min((i, j)) AS pos FROM qt WHERE j = 0 OR (length(term) > 1 AND NOT list_contains({_STOP}, term)) GROUP BY 1, 2),
 terms AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM qd),
 ea AS (SELECT t.query_id, s.w, min((t.n, s.i)) AS pos FROM terms t JOIN {_SYN} s ON s.k = t.term WHERE NOT EXISTS (SELECT 1 FROM terms u WHERE u.query_id = t.query_id AND u.term = s.w) GROUP BY 1, 2),
 expanded AS (SELECT query_id, w AS term, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM ea) WHERE n <= 12)"""


@query("plan_queries", "G1", "WITH " + _QUERIES + ", " + PLAN + f""" SELECT q.query_id, (SELECT string_agg(term, ' ' ORDER BY n) FROM terms t WHERE t.query_id = q.query_id) AS terms,
 coalesce((SELECT string_agg(term, ' ' ORDER BY n) FROM expanded t WHERE t.query_id = q.query_id), '') AS expanded,
 coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM qw WHERE qw.query_id = q.query_id AND {_CMP}), '') AS identifiers,
 (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT * FROM qw WHERE qw.query_id = q.query_id AND ({_CMP} OR (length(x) > 1 AND NOT list_contains({_STOP}, lower(x)))) ORDER BY i LIMIT 4)) AS subject
 FROM qs q""")
def plan_queries(spark, sf_dir):
    p = S.plan(queries(spark, sf_dir))
    return p.select("query_id", *[F.array_join(c, " ").alias(c) for c in ("terms", "expanded", "identifiers")], "subject")


def passages(spark, sf_dir):
    w = P.with_terms(P.windows(inputs.docs(spark, sf_dir)))
    pid = F.concat_ws(":", "path", F.lpad(F.col("line_start").cast("string"), 8, "0"))
    return w.withColumn("passage_id", pid)


_PASSAGES = windows_cte("docs", "w", 40, 30) + ", " + r"""ps AS (SELECT repo_id, path, line_start::INT AS line_start, line_end::INT AS line_end,
 concat(path, ':', lpad(line_start::VARCHAR, 8, '0')) AS passage_id, array_to_string(part, chr(10)) AS content FROM w)"""
_TOKS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
# Document text holds no compound identifiers that the SQL would have to split, so fields are content and path.
BM25 = f"""tk AS (SELECT passage_id, unnest({_TOKS.format('content')}) AS token, 1.0 AS wt FROM ps UNION ALL SELECT passage_id, unnest({_TOKS.format('path')}), 3.0 FROM ps),
 dls AS (SELECT passage_id, count(*) AS dl FROM tk GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
 qx AS (SELECT DISTINCT query_id, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS term FROM (SELECT query_id, term FROM terms UNION ALL SELECT query_id, term FROM expanded)),
 tf AS (SELECT x.term, tk.passage_id, sum(wt) AS tf FROM (SELECT DISTINCT term FROM qx WHERE term <> '') x JOIN tk ON CASE WHEN length(x.term) >= 3 THEN starts_with(tk.token, x.term)
  ELSE tk.token = x.term END GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 part AS (SELECT tf.term, passage_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
  FROM tf JOIN dfs USING (term) JOIN dls USING (passage_id), st),
 bm AS (SELECT query_id, passage_id, sum(s) AS score FROM qx JOIN part USING (term) GROUP BY 1, 2),
 ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rn FROM bm) WHERE rn <= 80)"""
_BASE = ctes(DOCS, _PASSAGES, _QUERIES, PLAN, BM25)


@query("bm25_candidates", "G2 G7", _BASE + " SELECT query_id, passage_id, round(score, 6) AS score FROM ranked")
def bm25_candidates(spark, sf_dir):
    index = S.build_index(passages(spark, sf_dir).select("passage_id", "content", "path"))
    return S.bm25(index, S.plan(queries(spark, sf_dir))).select("query_id", "passage_id", F.round("score", 6).alias("score"))


# Code and configuration passages; each question sees one repository or all, and one type of passage or all.
_CODE_WINDOWS = windows_cte("code", "w", P.CODE_WINDOW, P.CODE_STEP, "kind = 'source'")
_CONFIG_WINDOWS = windows_cte("code", "wc", P.CONFIG_WINDOW, P.CONFIG_WINDOW, "kind IN ('config', 'manifest')")
_TYPED = """ps AS (SELECT *, concat_ws(':', repo_id, path, memory_type, lpad(line_start::VARCHAR, 8, '0')) AS passage_id FROM (
  SELECT repo_id, path, 'code' AS memory_type, line_start, array_to_string(part, chr(10)) AS content FROM w
  UNION ALL SELECT repo_id, path, 'config', line_start, array_to_string(part, chr(10)) FROM wc)),
 sc AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 <> 0 THEN (item_id % 5)::VARCHAR END AS repo, CASE item_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'config' END AS type FROM benchmark)"""
_SCOPED = BM25.replace("FROM qx JOIN part USING (term) GROUP BY", """FROM qx JOIN part USING (term) JOIN ps USING (passage_id) JOIN sc USING (query_id)
  WHERE (sc.repo IS NULL OR sc.repo = ps.repo_id) AND (sc.type IS NULL OR sc.type = ps.memory_type) GROUP BY""")


@query("scoped_search", "G2 G7", ctes(CODE, _CODE_WINDOWS, _CONFIG_WINDOWS, _TYPED, _QUERIES, PLAN, _SCOPED) + " SELECT query_id, passage_id, round(score, 6) AS score FROM ranked")
def scoped_search(spark, sf_dir):
    files = inputs.code(spark, sf_dir)
    rows = P.windows(files.where("kind = 'source'")).unionByName(
        P.windows(files.where("kind IN ('config', 'manifest')"), "config", P.CONFIG_WINDOW, P.CONFIG_WINDOW))
    rows = rows.withColumn("passage_id", F.concat_ws(":", "repo_id", "path", "memory_type", F.lpad(F.col("line_start").cast("string"), 8, "0")))
    index = S.build_index(rows.select("passage_id", "repo_id", "memory_type", "content", "path"))
    item = F.col("item_id")
    types = F.when(item % 3 == 0, F.array(F.lit("code"))).when(item % 3 == 1, F.array(F.lit("config")))
    scope = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.when(item % 7 != 0, (item % 5).cast("string")).alias("repo_id"), types.alias("memory_types"))
    found = S.bm25(index, S.plan(queries(spark, sf_dir)), scope=scope)
    return found.select("query_id", "passage_id", F.round("score", 6).alias("score"))


_NEEDLES = """nd AS (SELECT query_id, term, n FROM (SELECT query_id, term, n FROM terms UNION ALL SELECT query_id, term, n + 1000 FROM expanded)),
 n10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS k FROM nd) WHERE k <= 10)"""


@query("substring_candidates", "G3", ctes(DOCS, _PASSAGES, _QUERIES, PLAN, _NEEDLES) + """ SELECT query_id, passage_id, round(0.8 * sum(least((length(lower(content)) -
 length(replace(lower(content), term, ''))) // length(term), 5)), 6) AS score FROM n10, ps GROUP BY 1, 2 HAVING bool_or(contains(lower(content), replace(term, '_', ''))
 OR contains(lower(path), replace(term, '_', '')))""")
def substring_candidates(spark, sf_dir):
    rows = S.substring_candidates(passages(spark, sf_dir), S.plan(queries(spark, sf_dir)))  # read once, so not stored
    return rows.select("query_id", "passage_id", F.round("score", 6).alias("score"))


# Identifier search over the code corpus: names of functions as queries.
@query("identifier_candidates", "G4", ctes(CODE, windows_cte("code", "w", 40, 30, "kind = 'source'")) + """, cp AS (
 SELECT concat_ws(':', repo_id, path, lpad(line_start::VARCHAR, 8, '0')) AS passage_id, array_to_string(part, chr(10)) AS content FROM w)
 SELECT p_partkey AS query_id, passage_id, 1.0::DOUBLE AS score FROM part JOIN cp ON contains(content, concat('checkEmail', p_partkey))""")
def identifier_candidates(spark, sf_dir):
    code = stored(P.windows(inputs.code(spark, sf_dir).where("kind = 'source'")).withColumn(
        "passage_id", F.concat_ws(":", "repo_id", "path", F.lpad(F.col("line_start").cast("string"), 8, "0"))))
    asked = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("where is checkEmail"), F.col("p_partkey").cast("string")).alias("text"))
    plans = S.plan(asked)
    none = code.select(F.lit(0).cast("long").alias("query_id"), "passage_id").where("false")
    return S.identifier_candidates(code, plans, none, per_identifier=None)


BOOST = f"""ids AS (SELECT query_id, x AS ident FROM qw WHERE {_CMP}), bst AS (SELECT r.query_id, r.passage_id, p.path, p.line_start, p.line_end, lower(p.content) AS low,
  lower(regexp_replace(regexp_extract(p.path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS stem, lower(p.path) AS pl, r.score, coalesce((SELECT sum(least((length(p.content) -
   length(replace(p.content, ident, ''))) // length(ident), 3)) FROM ids WHERE ids.query_id = r.query_id), 0) AS seen,
  (SELECT count(*) FROM ids WHERE ids.query_id = r.query_id) AS n_ids FROM ranked r JOIN ps p USING (passage_id)),
 tb AS (SELECT b.query_id, b.passage_id, sum(CASE WHEN t.term = stem OR (length(t.term) >= 4 AND contains(stem, t.term)) THEN 1.5 WHEN length(t.term) >= 3 AND contains(pl, t.term)
  THEN 0.6 ELSE 0 END) AS tb FROM bst b JOIN terms t USING (query_id) GROUP BY 1, 2),
 dd AS (SELECT b.query_id, b.passage_id, count(DISTINCT a.term) AS d FROM bst b JOIN (SELECT query_id, term FROM terms UNION SELECT query_id, term FROM expanded) a
  ON a.query_id = b.query_id AND contains(b.low, a.term) GROUP BY 1, 2),
 boosted AS (SELECT b.*, CASE WHEN seen > 0 THEN score + 4 * seen WHEN n_ids > 0 THEN score * 0.5 ELSE score END + coalesce(tb, 0) + least(coalesce(d, 0), 6) * 0.35 AS final
  FROM bst b LEFT JOIN tb USING (query_id, passage_id) LEFT JOIN dd USING (query_id, passage_id))"""


def _boosted(spark, sf_dir):
    ps = stored(passages(spark, sf_dir).select("passage_id", "repo_id", "path", "content", "symbol", "memory_type", "line_start", "line_end"))
    plans = S.plan(queries(spark, sf_dir))
    return S.boost(S.bm25(S.build_index(ps.drop("symbol")), plans), ps, plans)


@query("boosted_scores", "G5", _BASE + ", " + BOOST + " SELECT query_id, passage_id, round(final, 6) AS score FROM boosted")
def boosted_scores(spark, sf_dir):
    return _boosted(spark, sf_dir).select("query_id", "passage_id", F.round("score", 6).alias("score"))


@query("search_top_hits", "G6 G8 G9", _BASE + ", " + BOOST + """, sel AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(final, 9) DESC, passage_id) AS k FROM boosted),
 pairs AS (SELECT a.query_id, a.passage_id FROM sel a JOIN sel b ON a.query_id = b.query_id AND a.path = b.path AND b.k < a.k
  AND (least(a.line_end, b.line_end) - greatest(a.line_start, b.line_start) + 1) / least(a.line_end - a.line_start + 1, b.line_end - b.line_start + 1) >= 0.6),
 ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY k) AS kk FROM sel WHERE (query_id, passage_id) NOT IN (SELECT (query_id, passage_id) FROM pairs)),
 fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, passage_id) AS rank FROM ok WHERE kk <= 3)
 SELECT query_id, rank, path, passage_id, round(final, 6) AS score FROM fin WHERE rank <= 8""")
def search_top_hits(spark, sf_dir):
    return S.diversify(_boosted(spark, sf_dir)).select("query_id", "rank", "path", "passage_id", F.round("score", 6).alias("score"))


@query("focus_ranking", "G8", None)
def focus_ranking(spark, sf_dir):
    from sourcegrain.plans.passages import code_passages
    ps = stored(code_passages(spark, sf_dir).withColumn("passage_id", F.concat_ws(":", "repo_id", "path", "memory_type", F.lpad(F.col("line_start").cast("string"), 8, "0"))))
    rows = spark.createDataFrame(list(S.FOCUS_QUERIES.items()), "query_id string, text string")
    hits = S.search(ps, rows, limit=12)
    return hits.groupBy("query_id", "path").agg(F.min("rank").alias("first_rank"))


_CASES = " ".join("WHEN " + " OR ".join(f"contains(low, {q(w)})" for w in words) + f" THEN '{i}'" for i, words in T.QUESTION_INTENTS.items())
_ASK = ["where is the parser", "explain the architecture and structure", "find duplicate copies", "any secret leak", "what changed before", "run a security audit of everything", "demo tour please",
        "check jwt token and cors", "hello there", "prepare a walkthrough"]
_ASK_CASE = "CASE conv_id % 10 " + " ".join(f"WHEN {i} THEN {q(a)}" for i, a in enumerate(_ASK)) + " END"
_CONV = f"cv AS (SELECT conv_id, turn, concat(' ', lower(concat({_ASK_CASE}, ' ', text)), ' ') AS low FROM conversations)"


def _asked(spark, sf_dir):
    ask = F.element_at(F.array(*[F.lit(a) for a in _ASK]), (F.col("conv_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", ask, "text").alias("text"))


@query("question_intent", "G10", f"WITH {_CONV} SELECT conv_id, turn, CASE {_CASES} ELSE 'general' END AS intent FROM cv")
def question_intent(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", T.question_intent(F.col("text")).alias("intent"))


def _first(words):
    return "CASE " + " ".join(f"WHEN contains(low, {q(w)}) THEN {q(w)}" for w in words) + " END"


_TOPIC = " UNION ALL ".join(f"SELECT conv_id, turn, low, '{t}' AS topic, {_first(w)} AS hit FROM cv" for t, w in T.TASK_TOPICS.items())


@query("task_topics", "G11", f"""WITH {_CONV}, tp AS ({_TOPIC}), tg AS (SELECT *, max(hit) OVER (PARTITION BY conv_id, turn) IS NULL AS none,
 {' OR '.join(f"contains(low, {q(w)})" for w in T.FULL_WORDS)} AS everything, max(CASE WHEN topic = 'walkthrough' THEN hit END) OVER (PARTITION BY conv_id, turn) IS NOT NULL AS walk FROM tp)
 SELECT conv_id, turn, topic, hit IS NOT NULL OR none OR everything OR walk AS selected, CASE WHEN hit IS NOT NULL THEN concat('Task mentions ''', trim(hit), '''')
 WHEN none THEN 'No specific focus detected: full analysis' WHEN everything THEN 'Full analysis requested' WHEN walk THEN 'Required by walkthrough'
 ELSE 'Not required for this task' END AS reason FROM tg""")
def task_topics(spark, sf_dir):
    return T.route_topics(_asked(spark, sf_dir), "text", T.TASK_TOPICS, T.DEPENDENCIES, T.FULL_WORDS).select("conv_id", "turn", "topic", "selected", "reason")


_SCAN = " UNION ALL ".join(f"SELECT conv_id, turn, '{t}' AS topic, {_first(w)} AS hit FROM cv" for t, w in T.SCANNER_KEYWORDS.items())


@query("focused_scanners", "G12", f"""WITH {_CONV}, tp AS ({_SCAN}), tg AS (SELECT *, max(hit) OVER (PARTITION BY conv_id, turn) IS NULL AS none FROM tp)
 SELECT conv_id, turn, topic, hit IS NOT NULL OR none AS selected FROM tg""")
def focused_scanners(spark, sf_dir):
    return T.route_topics(_asked(spark, sf_dir), "text", T.SCANNER_KEYWORDS).select("conv_id", "turn", "topic", "selected")
