"""Passage and tokenisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.functions import identifiers as ids
from sourcegrain.operators import facts
from sourcegrain.operators import passages as P
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, CODE_LINES, DOCS, ctes, hash_sql
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import q
from sourcegrain.session import stored
from sourcegrain.sources.corpus import explode_lines, table

_TEXT = "array_to_string(part, chr(10))"


def windows_cte(source: str, name: str, window: int, step: int, where: str = "true") -> str:
    return f"""{name} AS (SELECT *, {hash_sql('part')} AS sha FROM (
 SELECT *, lines[line_start:line_end] AS part FROM (SELECT *, least(len(lines), line_start + {window} - 1) AS line_end FROM (
  SELECT repo_id, path, lines, unnest(range(0, CASE WHEN len(lines) = 0 THEN 0
   ELSE 1 + ceil(greatest(len(lines) - {window}, 0) / {step}.0)::BIGINT END)) * {step} + 1 AS line_start
  FROM {source} WHERE {where}))) WHERE regexp_matches({_TEXT}, '\\S'))"""


@query("line_window_passages", "B1 B4", ctes(DOCS, windows_cte("docs", "w", 40, 30)) +
       f"SELECT repo_id, path, line_start, line_end, {_TEXT} AS content, sha AS sha256 FROM w")
def line_window_passages(spark, sf_dir):
    return P.windows(inputs.docs(spark, sf_dir)).select("repo_id", "path", "line_start", "line_end", "content", "sha256")


@query("config_window_passages", "B1", ctes(CODE, windows_cte("code", "w", 60, 60, "kind IN ('config', 'manifest')")) +
       "SELECT repo_id, path, line_start, line_end, sha AS sha256 FROM w")
def config_window_passages(spark, sf_dir):
    files = inputs.code(spark, sf_dir).where("kind IN ('config', 'manifest')")
    return P.windows(files, "config", 60, 60).select("repo_id", "path", "line_start", "line_end", "sha256")


_SECTIONS = r"""d AS (SELECT *, regexp_matches(line, '^\s{0,3}#{1,6}\s+(.*)$') AS is_head FROM code_lines WHERE kind = 'doc'),
 g AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY repo_id, path ORDER BY line_no) AS sec FROM d),
 h AS (SELECT *, min(line_no) OVER (PARTITION BY repo_id, path, sec) AS sec_start FROM g),
 c AS (SELECT *, (line_no - sec_start) // 60 AS chunk FROM h),
 s AS (SELECT repo_id, path, min(line_no) AS line_start, max(line_no) AS line_end,
 string_agg(line, chr(10) ORDER BY line_no) AS content,
 max(CASE WHEN line_no = sec_start AND is_head THEN regexp_replace(regexp_extract(line, '^\s{0,3}#{1,6}\s+(.*)$', 1),
  '^\s+|\s+$', '', 'g') END) AS own, min(chunk) AS chunk, min(sec) AS sec FROM c GROUP BY repo_id, path, sec, chunk)"""


@query("heading_sections", "B2", ctes(CODE, CODE_LINES) + ", " + _SECTIONS + r"""
SELECT * FROM (SELECT repo_id, path, line_start, line_end, content, max(own) OVER (PARTITION BY repo_id, path, sec) AS symbol FROM s)
WHERE regexp_matches(content, '\S')""")
def heading_sections(spark, sf_dir):
    files = inputs.code(spark, sf_dir).where("kind = 'doc'")
    return P.sections(files).select("repo_id", "path", "line_start", "line_end", "content", "symbol")


_TOKENS = r"regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')"
_CORE = "trim(tok, '_')"
_COMPOUND = (f"(strpos({_CORE}, '_') > 0 OR (regexp_matches({_CORE}, '[A-Z]') AND regexp_matches({_CORE}, '[a-z]') "
             f"AND regexp_matches(substr({_CORE}, 2), '[A-Z]')))")
_PARTS = (r"list_transform(regexp_extract_all(regexp_replace(replace(tok, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), "
          r"'[A-Z]?[a-z]+|[A-Z]+|\d+'), lambda p: lower(p))")
_TOK_CTE = f"toks AS (SELECT DISTINCT tok FROM (SELECT unnest({_TOKENS}) AS tok FROM code_lines))"


@query("split_identifiers", "B8 B9", ctes(CODE, CODE_LINES, _TOK_CTE) +
       f"SELECT tok, {_COMPOUND} AS compound, array_to_string({_PARTS}, ' ') AS parts FROM toks")
def split_identifiers(spark, sf_dir):
    lines = explode_lines(inputs.code(spark, sf_dir))
    toks = lines.select(F.explode(F.regexp_extract_all("line", F.lit(ids.IDENTIFIER), F.lit(0))).alias("tok")).distinct()
    return toks.select("tok", ids.is_compound(F.col("tok")).alias("compound"),
                       F.array_join(ids.split_identifier(F.col("tok")), " ").alias("parts"))


@query("expand_file_terms", "B10", ctes(CODE, CODE_LINES) + f""", t AS (SELECT repo_id, path, line_no, unnest({_TOKENS}) AS tok,
 unnest(range(1, len({_TOKENS}) + 1)) AS i FROM code_lines), p AS (SELECT repo_id, path, line_no, i,
 unnest({_PARTS}) AS part, unnest(range(1, len({_PARTS}) + 1)) AS j FROM t WHERE {_COMPOUND}),
 f AS (SELECT repo_id, path, part, min((line_no, i, j)) AS pos FROM p WHERE length(part) > 1 GROUP BY 1, 2, 3)
SELECT repo_id, path, string_agg(part, ' ' ORDER BY pos) AS terms FROM f GROUP BY 1, 2""")
def expand_file_terms(spark, sf_dir):
    files = inputs.code(spark, sf_dir)
    terms = ids.expand_terms(F.array_join("lines", "\n"))
    return files.select("repo_id", "path", F.array_join(terms, " ").alias("terms")).where("terms <> ''")


@query("label_quality_by_passages", "B1", ctes(DOCS, windows_cte("docs", "w", 40, 30)) + """
SELECT l.quality, l.toxic, count(*) AS passages FROM w JOIN docs d ON d.repo_id = w.repo_id AND d.path = w.path
 JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2""")
def label_quality_by_passages(spark, sf_dir):
    w = P.windows(inputs.docs(spark, sf_dir), keep=("repo_id", "path", "doc_id"))
    return (w.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic")
            .agg(F.count("*").alias("passages")))


def code_passages(spark, sf_dir, cap=None):
    return P.index(stored(facts.parse(inputs.code(spark, sf_dir))), cap)
