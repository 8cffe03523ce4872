"""Question-answering queries over the code corpus: one question per seed row."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import passages as P
from sourcegrain.operators import qa as A
from sourcegrain.operators import search as S
from sourcegrain.operators import verify as V
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, ctes, hash_sql
from sourcegrain.plans.passages import windows_cte
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import CODE_CLAIMS, code_claims, rx
from sourcegrain.session import shuffled, stored
from sourcegrain.sources.corpus import spread, table


def _question_hits(spark, sf_dir):
    ps = stored(P.windows(inputs.code(spark, sf_dir).where("kind = 'source'")).withColumn(
        "passage_id", F.concat_ws(":", "repo_id", "path", F.lpad(F.col("line_start").cast("string"), 8, "0"))))
    asked = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("checkEmail"), F.col("p_partkey").cast("string"), F.lit(" value")).alias("text"))
    plans = stored(S.plan(asked))
    none = ps.select(F.lit(0).cast("long").alias("query_id"), "passage_id").where("false")
    found = S.identifier_candidates(ps, plans, none, None)
    hits = stored(found.join(shuffled(ps), "passage_id").withColumn("rank", F.lit(1)))
    return hits, plans


_HITS = windows_cte("code", "w", 40, 30, "kind = 'source'") + """, qh AS (SELECT p.p_partkey AS query_id, concat('checkEmail', p.p_partkey) AS ident, w.path, w.line_start, w.part FROM part p JOIN w
 ON contains(array_to_string(w.part, chr(10)), concat('checkEmail', p.p_partkey))),
 ql AS (SELECT query_id, ident, path, line_start + unnest(range(0, len(part))) AS line, unnest(part) AS s FROM qh)"""


@query("identifier_occurrences", "G14", ctes(CODE, _HITS) + " SELECT DISTINCT query_id, ident AS identifier, path, line::INT AS line FROM ql WHERE contains(s, ident)")
def identifier_occurrences(spark, sf_dir):
    hits, plans = _question_hits(spark, sf_dir)
    return A.identifier_occurrences(hits, plans)


@query("key_lines", "G13", ctes(CODE, _HITS) + f""", c AS (SELECT DISTINCT query_id, ident, path, line, s, lower(s) AS low FROM ql WHERE contains(s, ident) AND {rx(A.INTERESTING, 's')}
  AND NOT regexp_matches(ltrim(s), '^(//|#|\\*)')),
 t AS (SELECT *, [lower(ident), 'check', 'email', regexp_extract(ident, '([0-9]+)$', 1), 'value'] AS ts, ['validation', 'validate', 'valid', 'sanitize', 'mail'] AS unused FROM c),
 m AS (SELECT *, list_filter(list_distinct(list_concat(ts, ['mail'])), lambda x: length(x) > 2 AND contains(low, x)) AS mt FROM t),
 sc AS (SELECT *, len(mt) + len(list_filter(mt, lambda x: list_contains(ts, x))) + 4 - CASE WHEN {rx(A.IMPORTING, 's')} THEN 1.5 ELSE 0 END
  + CASE WHEN {rx(A.DEFINING, 's')} THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(s, concat('\\b', ident, '\\s*=([^=]|$)')) THEN 2 ELSE 0 END AS score FROM m)
 SELECT query_id, n, path, line::INT AS line, round(score, 3)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, line) AS n FROM sc) WHERE n <= 3""")
def key_lines(spark, sf_dir):
    hits, plans = _question_hits(spark, sf_dir)
    return A.key_lines(hits, plans).select("query_id", "n", "path", "line", F.round("score", 3).alias("score"))


@query("names_in_hits", "G15", None)
def names_in_hits(spark, sf_dir):
    hits, plans = _question_hits(spark, sf_dir)
    return A.names_in_hits(hits, plans)


@query("answer_citations", "G9", ctes(CODE, _HITS) + f""", ck AS (SELECT p.p_partkey AS query_id, CASE WHEN c.path IS NULL THEN 'missing'
  WHEN {hash_sql('c.lines[w.line_start:w.line_end]')} = w.sha THEN 'verified' ELSE 'stale' END AS status FROM part p JOIN w ON contains(array_to_string(w.part, chr(10)), concat('checkEmail', p.p_partkey))
  LEFT JOIN code c ON c.repo_id = w.repo_id AND c.path = w.path)
 SELECT query_id, status, count(*) AS citations FROM ck GROUP BY 1, 2""")
def answer_citations(spark, sf_dir):
    # the passages of an answer are re-verified against the current files
    hits, _ = _question_hits(spark, sf_dir)
    cites = hits.select("query_id", "repo_id", "path", "line_start", "line_end", F.col("sha256").alias("evidence_sha256"), F.lit(None).cast("string").alias("file_sha256"))
    checked = V.verify(cites, inputs.code(spark, sf_dir))
    return checked.groupBy("query_id", "status").agg(F.count("*").alias("citations"))


@query("answer_rows", "G17", None)
def answer_rows(spark, sf_dir):
    hits, plans = _question_hits(spark, sf_dir)
    return A.answer_rows(hits, A.names_in_hits(hits, plans))


@query("findings_summary", "G16", CODE_CLAIMS + """, o AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sr FROM claims),
 n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY sr, path, line_no, title) AS n, count(*) OVER (PARTITION BY repo_id) AS total FROM o),
 b AS (SELECT repo_id, string_agg(concat(c, ' ', severity), ', ' ORDER BY sr) AS breakdown FROM (SELECT repo_id, severity, sr, count(*) AS c FROM o GROUP BY 1, 2, 3) GROUP BY 1)
 SELECT repo_id, n, severity, title, path, line_no AS line, total, breakdown FROM n JOIN b USING (repo_id) WHERE n <= 6""")
def findings_summary(spark, sf_dir):
    return A.findings_summary(code_claims(spark, sf_dir).withColumnRenamed("line_no", "line"))


@query("first_sentences", "G17", r"SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE concat(left(s, 219), '…') END AS sentence FROM (SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?s)^(.*?[.!?])\s', 1), ''), t) AS s FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents))")
def first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", A.first_sentence(F.col("text")).alias("sentence"))

