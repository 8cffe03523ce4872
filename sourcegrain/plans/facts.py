"""Code-fact queries; the oracles work on exploded lines with joins and windows instead of arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.functions import blocks as B
from sourcegrain.operators import facts as C
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import CODE, CODE_LINES, ctes
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import q, rx
from sourcegrain.session import stored

JS = "language IN ('javascript', 'typescript')"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def ex(pattern: str, group: int, col: str = "line") -> str:
    return f"regexp_extract({col}, {q(pattern)}, {group})"


def parsed(spark, sf_dir, *only):
    return C.parse(inputs.code(spark, sf_dir), *only)


def fact_table(spark, sf_dir):
    """The facts as a written table, for jobs that read them more than once."""
    return stored(parsed(spark, sf_dir))


_HIDE = "CASE WHEN t IN ('{', '}', chr(10)) THEN t WHEN regexp_matches(t, '^(/|`)') THEN regexp_replace(t, '[^\\n]', '', 'g') ELSE '' END"
BRACES = f"""bl AS (SELECT repo_id, path, unnest(range(1, len(b) + 1))::INT AS line_no, unnest(b) AS s FROM (SELECT repo_id, path,
 string_split(array_to_string(list_transform(regexp_extract_all(array_to_string(lines, chr(10)), {q(B.CODE_TOKENS)}),
 lambda t: {_HIDE}), ''), chr(10)) AS b FROM code WHERE {JS} OR language = 'go')),
 br AS (SELECT repo_id, path, line_no, unnest(range(1, length(s) + 1)) AS k, unnest(string_split(s, '')) AS c FROM bl WHERE s <> ''),
 brd AS (SELECT *, CASE WHEN c = '{{' THEN 1 ELSE -1 END AS d FROM br)"""


def ends_cte(name: str, heads: str) -> str:
    """(repo_id, path, line_no, block_end) for every row of ``heads``."""
    return f"""{name} AS (SELECT repo_id, path, head, min(line_no) AS block_end FROM (SELECT h.repo_id, h.path, h.line_no AS head, b.line_no, b.d,
 sum(b.d) OVER w AS depth, max(b.d) OVER (PARTITION BY h.repo_id, h.path, h.line_no ORDER BY b.line_no, b.k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened
 FROM {heads} h JOIN brd b ON b.repo_id = h.repo_id AND b.path = h.path AND b.line_no >= h.line_no
 WINDOW w AS (PARTITION BY h.repo_id, h.path, h.line_no ORDER BY b.line_no, b.k))
 WHERE d = -1 AND opened = 1 AND depth <= 0 GROUP BY 1, 2, 3)"""


_ARROW_TEXT = "array_to_string(lines[line_no:line_no + 3], ' ')"
_AT = ("list_filter([line_no, line_no + 1, line_no + 2], lambda i: i <= len(lines) AND strpos(lines[i], '=>') > 0)[1]")
JS_HEADS = f"""jl AS (SELECT l.*, c.lines FROM code_lines l JOIN code c USING (repo_id, path) WHERE l.{JS}),
 jh AS (SELECT *, CASE WHEN {ex(C.JS_CLASS, 1)} <> '' THEN 'class' WHEN {ex(C.JS_FUNCTION, 1)} <> '' THEN 'function'
  WHEN {ex(C.JS_VARIABLE, 1)} <> '' OR {ex(C.JS_EXPORTS_FN, 1)} <> '' THEN 'var' END AS k,
  CASE WHEN {ex(C.JS_VARIABLE, 1)} <> '' THEN {ex(C.JS_VARIABLE, 2)} ELSE {ex(C.JS_EXPORTS_FN, 2)} END AS shape,
  CASE WHEN {ex(C.JS_CLASS, 1)} <> '' THEN {ex(C.JS_CLASS, 1)} WHEN {ex(C.JS_FUNCTION, 1)} <> '' THEN {ex(C.JS_FUNCTION, 1)}
   WHEN {ex(C.JS_VARIABLE, 1)} <> '' THEN {ex(C.JS_VARIABLE, 1)} ELSE {ex(C.JS_EXPORTS_FN, 1)} END AS name FROM jl),
 jf AS (SELECT * FROM jh WHERE k IN ('class', 'function') OR (k = 'var' AND (shape LIKE 'function%' OR shape LIKE '%=>%'
  OR (strpos({_ARROW_TEXT}, '=>') > 0 AND (strpos({_ARROW_TEXT}, ';') = 0 OR strpos({_ARROW_TEXT}, '=>') < strpos({_ARROW_TEXT}, ';')))))),
 {BRACES}, {ends_cte("je", "jf")},
 ja AS (SELECT *, CASE WHEN k = 'var' AND shape NOT LIKE 'function%' THEN {_AT} END AS arrow_at FROM jf),
 jb AS (SELECT *, CASE WHEN arrow_at IS NOT NULL AND NOT regexp_matches(lines[arrow_at], '=>\\s*\\{{')
   AND NOT (regexp_matches(lines[arrow_at], '=>\\s*$') AND regexp_matches(coalesce(lines[arrow_at + 1], ''), '^\\s*\\{{'))
   THEN coalesce(list_filter(range(arrow_at, least(len(lines), arrow_at + 29) + 1), lambda e: regexp_matches(lines[e], '(;|\\),|\\))\\s*$'))[1], arrow_at) END AS arrow_end
  FROM ja),
 js_heads AS (SELECT b.repo_id, b.path, b.name, CASE WHEN k = 'class' THEN 'class' ELSE 'function' END AS kind, b.line_no AS line_start,
  CASE WHEN k = 'class' THEN coalesce(block_end, b.line_no) WHEN arrow_end IS NOT NULL THEN arrow_end
   WHEN regexp_matches(line, ';\\s*$') AND strpos(line, '{{') = 0 THEN b.line_no ELSE coalesce(block_end, b.line_no) END::INT AS line_end,
  NULL::VARCHAR AS parent FROM jb b LEFT JOIN je ON je.repo_id = b.repo_id AND je.path = b.path AND je.head = b.line_no)"""
_NOT_METHODS = ", ".join(q(x) for x in C.NOT_METHODS)
JS_METHODS = f"""mh AS (SELECT l.repo_id, l.path, l.line_no, {ex(C.JS_METHOD, 1, 'l.line')} AS name, h.name AS parent FROM js_heads h JOIN code_lines l
  ON l.repo_id = h.repo_id AND l.path = h.path AND l.line_no > h.line_start AND l.line_no < h.line_end
  WHERE h.kind = 'class' AND {rx(C.JS_METHOD, 'l.line')} AND {ex(C.JS_METHOD, 1, 'l.line')} NOT IN ({_NOT_METHODS})),
 {ends_cte("me", "mh")},
 js_methods AS (SELECT m.repo_id, m.path, m.name, 'method' AS kind, m.line_no AS line_start, coalesce(block_end, m.line_no)::INT AS line_end, m.parent
  FROM mh m LEFT JOIN me ON me.repo_id = m.repo_id AND me.path = m.path AND me.head = m.line_no)"""
PY_SYMBOLS = f"""pl AS (SELECT * FROM code_lines WHERE language = 'python'),
 pf AS (SELECT *, CASE WHEN {rx(C.PY_CLASS)} THEN 'class' ELSE 'function' END AS k,
  length(CASE WHEN {rx(C.PY_CLASS)} THEN {ex(C.PY_CLASS, 1)} ELSE {ex(C.PY_DEF, 1)} END) AS indent,
  CASE WHEN {rx(C.PY_CLASS)} THEN {ex(C.PY_CLASS, 2)} ELSE {ex(C.PY_DEF, 2)} END AS name FROM pl
  WHERE {rx(C.PY_CLASS)} OR {rx(C.PY_DEF)}),
 pd AS (SELECT *, regexp_replace(line, '#.*$', '') AS code, length(line) - length(ltrim(line)) AS ind, regexp_matches(line, '\\S') AS filled FROM pl),
 ps AS (SELECT f.repo_id, f.path, f.line_no AS head, l.line_no, regexp_matches(l.code, ':\\s*$') AS colon,
  sum(length(regexp_replace(l.code, '[^(\\[{{]', '', 'g')) - length(regexp_replace(l.code, '[^)\\]}}]', '', 'g')))
   OVER (PARTITION BY f.repo_id, f.path, f.line_no ORDER BY l.line_no) AS depth FROM pf f JOIN pd l
  ON l.repo_id = f.repo_id AND l.path = f.path AND l.line_no >= f.line_no AND l.line_no < f.line_no + 30),
 pg AS (SELECT repo_id, path, head, min(line_no) AS sig, min_by(colon, line_no) AS colon FROM ps WHERE depth <= 0 GROUP BY 1, 2, 3),
 pb AS (SELECT f.*, coalesce(g.sig, f.line_no) AS body, g.sig IS NOT NULL AND NOT g.colon AS one FROM pf f LEFT JOIN pg g
  ON g.repo_id = f.repo_id AND g.path = f.path AND g.head = f.line_no),
 pc AS (SELECT b.*, (SELECT min(l.line_no) FROM pd l WHERE l.repo_id = b.repo_id AND l.path = b.path AND l.line_no > b.body AND l.filled
  AND l.ind <= b.indent AND NOT ltrim(l.line) LIKE '#%') AS closer FROM pb b),
 pe AS (SELECT c.*, CASE WHEN one THEN body ELSE coalesce((SELECT max(l.line_no) FROM pd l WHERE l.repo_id = c.repo_id AND l.path = c.path
  AND l.line_no > c.body AND l.line_no < coalesce(c.closer, 1000000) AND l.filled), body) END::INT AS line_end FROM pc c),
 py_symbols AS (SELECT a.repo_id, a.path, a.name, CASE WHEN a.k = 'class' THEN 'class' WHEN p.name IS NULL THEN 'function' ELSE 'method' END AS kind,
  a.line_no AS line_start, a.line_end, p.name AS parent FROM pe a LEFT JOIN LATERAL (SELECT name FROM pe o WHERE o.repo_id = a.repo_id AND o.path = a.path
   AND o.k = 'class' AND o.line_no <= a.line_no AND o.line_end >= a.line_no AND a.indent > o.indent ORDER BY o.line_no DESC LIMIT 1) p ON true)"""
GO_SYMBOLS = f"""gh AS (SELECT *, {ex(C.GO_FUNC, 1)} AS name FROM code_lines WHERE language = 'go' AND {rx(C.GO_FUNC)}),
 {ends_cte("ge", "gh")}, go_symbols AS (SELECT g.repo_id, g.path, g.name, 'function' AS kind, g.line_no AS line_start,
  coalesce(block_end, g.line_no)::INT AS line_end, NULL::VARCHAR AS parent FROM gh g LEFT JOIN ge ON ge.repo_id = g.repo_id AND ge.path = g.path AND ge.head = g.line_no)"""
ALL_SYMBOLS = ", ".join([JS_HEADS, JS_METHODS, PY_SYMBOLS, GO_SYMBOLS]) + """,
 symbols AS (SELECT * FROM js_heads UNION ALL SELECT * FROM js_methods UNION ALL SELECT * FROM py_symbols UNION ALL SELECT * FROM go_symbols)"""
SYMBOL_BASE = ctes(CODE, CODE_LINES, ALL_SYMBOLS)
_COLS = "repo_id, path, name, kind, line_start, line_end, parent"


def symbol_rows(spark, sf_dir, where: str):
    return C.table(parsed(spark, sf_dir, "symbols"), "symbols", "language").where(where).select(*_COLS.split(", "))


@query("js_symbols", "C1 C3 C4", ctes(CODE, CODE_LINES, JS_HEADS) + f"SELECT {_COLS} FROM js_heads")
def js_symbols(spark, sf_dir):
    return symbol_rows(spark, sf_dir, JS + " AND kind <> 'method'")


@query("js_methods", "C2 C3", ctes(CODE, CODE_LINES, JS_HEADS, JS_METHODS) + f"SELECT {_COLS} FROM js_methods")
def js_methods(spark, sf_dir):
    return symbol_rows(spark, sf_dir, JS + " AND kind = 'method'")


@query("python_symbols", "C5 C6", ctes(CODE, CODE_LINES, PY_SYMBOLS) + f"SELECT {_COLS} FROM py_symbols")
def python_symbols(spark, sf_dir):
    return symbol_rows(spark, sf_dir, "language = 'python'")


@query("go_symbols", "C7", ctes(CODE, CODE_LINES, BRACES, GO_SYMBOLS) + f"SELECT {_COLS} FROM go_symbols")
def go_symbols(spark, sf_dir):
    return symbol_rows(spark, sf_dir, "language = 'go'")


def names_sql(clause: str) -> str:
    tok = "regexp_replace(" + STRIP.format("t") + ", '^type ', '')"
    local = f"trim(string_split(string_split(trim({tok}), ' as ')[-1], ':')[-1])"
    return (f"list_filter(list_transform(string_split_regex({clause}, '[{{}},]'), lambda t: {local}), "
            f"lambda t: regexp_matches(t, '^{C.ID}$'))")


JS_IMPORTS = f"""ji AS (
 SELECT repo_id, path, line_no AS line, {ex(C.JS_IMPORT_FROM, 2)} AS module, array_to_string({names_sql(ex(C.JS_IMPORT_FROM, 1))}, ',') AS names
  FROM code_lines WHERE {JS} AND {rx(C.JS_IMPORT_FROM)}
 UNION ALL SELECT repo_id, path, line_no, {ex(C.JS_IMPORT_ONLY, 1)}, '' FROM code_lines WHERE {JS} AND {rx(C.JS_IMPORT_ONLY)} AND NOT {rx(C.JS_IMPORT_FROM)}
 UNION ALL SELECT repo_id, path, line_no, m, array_to_string({names_sql('c')}, ',') FROM (SELECT repo_id, path, line_no,
  unnest(regexp_extract_all(line, {q(C.JS_REQUIRE)}, 1)) AS c, unnest(regexp_extract_all(line, {q(C.JS_REQUIRE)}, 2)) AS m FROM code_lines WHERE {JS}))"""
PY_IMPORTS = f"""pi AS (
 SELECT repo_id, path, line_no AS line, {ex(C.PY_FROM, 1)} AS module, array_to_string(list_filter(list_transform(string_split({ex(C.PY_FROM, 2)}, ','),
  lambda t: trim(string_split(trim(t), ' as ')[-1])), lambda t: t <> '' AND t <> '*'), ',') AS names FROM code_lines WHERE language = 'python' AND {rx(C.PY_FROM)}
 UNION ALL SELECT repo_id, path, line_no, trim(string_split(trim(unnest(string_split({ex(C.PY_IMPORT, 1)}, ','))), ' as ')[1]), '' FROM code_lines
  WHERE language = 'python' AND {rx(C.PY_IMPORT)} AND NOT {rx(C.PY_FROM)})"""


def import_rows(spark, sf_dir, where):
    rows = C.table(parsed(spark, sf_dir, "imports"), "imports", "language").where(where)
    return rows.select("repo_id", "path", "line", "module", F.array_join("names", ",").alias("names"))


@query("js_imports", "C8", ctes(CODE, CODE_LINES, JS_IMPORTS) + "SELECT * FROM ji")
def js_imports(spark, sf_dir):
    return import_rows(spark, sf_dir, JS)


@query("python_imports", "C10", ctes(CODE, CODE_LINES, PY_IMPORTS) + "SELECT * FROM pi")
def python_imports(spark, sf_dir):
    return import_rows(spark, sf_dir, "language = 'python'")


JS_EXPORTS = f"""xj AS (SELECT l.*, c.lines FROM code_lines l JOIN code c USING (repo_id, path) WHERE l.{JS}),
 xe AS (SELECT repo_id, path, line_no, 1 AS o, unnest({names_sql("string_split(string_split(array_to_string(lines[line_no:line_no + 24], ' '), '{')[2], '}')[1]")}) AS name
   FROM xj WHERE {rx(C.JS_MODULE_EXPORTS)}
  UNION ALL SELECT repo_id, path, line_no, 2, {ex(C.JS_EXPORT_DECL, 1)} FROM xj WHERE {rx(C.JS_EXPORT_DECL)}
  UNION ALL SELECT repo_id, path, line_no, 3, {ex(C.JS_EXPORTS_ASSIGN, 1)} FROM xj WHERE {rx(C.JS_EXPORTS_ASSIGN)}
  UNION ALL SELECT repo_id, path, line_no, 4, unnest({names_sql(ex(C.JS_EXPORT_LIST, 1))}) FROM xj WHERE {rx(C.JS_EXPORT_LIST)}),
 exported AS (SELECT DISTINCT repo_id, path, name FROM xe)"""


@query("js_exports", "C9", ctes(CODE, CODE_LINES, JS_EXPORTS) + "SELECT * FROM exported")
def js_exports(spark, sf_dir):
    return (parsed(spark, sf_dir, "exports").where(JS).select("repo_id", "path", F.explode("exports").alias("name")))


@query("python_exports", "C10", ctes(CODE, CODE_LINES, PY_SYMBOLS) + """SELECT repo_id, path, string_agg(name, ',' ORDER BY line_start) AS exports
 FROM py_symbols WHERE parent IS NULL AND name NOT LIKE '!_%' ESCAPE '!' GROUP BY 1, 2""")
def python_exports(spark, sf_dir):
    return (parsed(spark, sf_dir, "exports").where("language = 'python'")
            .select("repo_id", "path", F.array_join("exports", ",").alias("exports")))


_ROUTE2 = (r"""\b(app|router|server|routes?|""" + C.ID + r"""(?:Router|App|router|app))\.(get|post|put|patch|delete|all|options|head)\(\s*"""
           r"""(?:'([^'"`]+)'|"([^'"`]+)"|`([^'"`]+)`)(.*)$""")
_REST = ex(_ROUTE2, 6)
_IDS = (f"list_transform(list_filter(string_split({_REST}, ',')[2:], lambda a: {rx(C.ROUTE_ARGUMENT, STRIP.format('a'))}), "
        f"lambda a: {ex(C.ROUTE_ARGUMENT, 1, STRIP.format('a'))})")
JS_ROUTES = f"""jr AS (SELECT *, {ex(_ROUTE2, 2)} AS verb, concat({ex(_ROUTE2, 3)}, {ex(_ROUTE2, 4)}, {ex(_ROUTE2, 5)}) AS rpath, {_IDS} AS ids,
  NOT regexp_matches({_REST}, '=>|function') AND regexp_matches({_REST}, '(\\)|\\);)\\s*$') AND len({_IDS}) > 0 AS named FROM code_lines WHERE {JS} AND {rx(_ROUTE2)}),
 {ends_cte("re", "jr")},
 js_routes AS (SELECT r.repo_id, r.path, r.line_no AS line, CASE WHEN named THEN r.line_no ELSE coalesce(block_end, r.line_no) END::INT AS line_end,
  upper(verb) AS method, rpath AS route_path, array_to_string(CASE WHEN named THEN ids[:-2] ELSE ids END, ',') AS middlewares,
  CASE WHEN named THEN ids[-1] END AS handler FROM jr r LEFT JOIN re ON re.repo_id = r.repo_id AND re.path = r.path AND re.head = r.line_no)"""
PY_ROUTES = f"""pr AS (SELECT *, lower({ex(C.PY_ROUTE, 2)}) AS verb, {ex(C.PY_ROUTE, 3)} AS rpath, {ex(C.PY_METHODS, 1, ex(C.PY_ROUTE, 4))} AS listed
  FROM code_lines WHERE language = 'python' AND {rx(C.PY_ROUTE)}),
 py_routes AS (SELECT r.repo_id, r.path, r.line_no AS line, coalesce(h.line_end, r.line_no)::INT AS line_end,
  upper(CASE WHEN verb NOT IN ('route', 'api_route') THEN verb WHEN listed <> '' THEN trim(string_split(listed, ',')[1], ' ''"') ELSE 'GET' END) AS method,
  rpath AS route_path, '' AS middlewares, h.name AS handler FROM pr r LEFT JOIN LATERAL (SELECT name, line_end FROM py_symbols s WHERE s.repo_id = r.repo_id
  AND s.path = r.path AND s.kind <> 'class' AND s.line_start > r.line_no AND s.line_start <= r.line_no + 7 ORDER BY s.line_start LIMIT 1) h ON true)"""
ROUTES = f"{JS_ROUTES}, {PY_ROUTES}, routes AS (SELECT * FROM js_routes UNION ALL SELECT * FROM py_routes)"


def route_rows(spark, sf_dir, where="true"):
    rows = C.table(parsed(spark, sf_dir, "routes"), "routes", "language").where(where)
    return rows.select("repo_id", "path", "line", "line_end", "method", "route_path", F.array_join("middlewares", ",").alias("middlewares"), "handler")


@query("js_routes", "C11", ctes(CODE, CODE_LINES, BRACES, JS_ROUTES) + "SELECT * FROM js_routes")
def js_routes(spark, sf_dir):
    return route_rows(spark, sf_dir, JS)


@query("python_routes", "C12", ctes(CODE, CODE_LINES, PY_SYMBOLS, PY_ROUTES) + "SELECT * FROM py_routes")
def python_routes(spark, sf_dir):
    return route_rows(spark, sf_dir, "language = 'python'")


_QUOTED = r"""(?:'([^'"`]+)'|"([^'"`]+)"|`([^'"`]+)`)"""


def _each(pattern: str, *groups: int) -> str:
    return "concat(" + ", ".join(f"unnest(regexp_extract_all(line, {q(pattern)}, {g}))" for g in groups) + ")"


_LIVE = "NOT regexp_matches(ltrim(line), '^(//|#|\\*)')"
_FETCH2, _AXIOS2 = r"\bfetch\(\s*" + _QUOTED, r"\baxios\.(get|post|put|patch|delete)\(\s*" + _QUOTED
_API2 = r"(?:^|[^\w$.])(" + C.ID + r")\(\s*(?:'(/(?:api|v\d+)/[^'" + '"`]*)' + r"'" + r'|"(/(?:api|v\d+)/[^' + "'" + r'"`]*)"|`(/(?:api|v\d+)/[^' + "'" + r'"`]*)`)(\s*,)?'
CALLS = f"""cl AS (SELECT l.*, array_to_string(c.lines[line_no:line_no + 7], ' ') AS near FROM code_lines l JOIN code c USING (repo_id, path)
  WHERE ({JS.replace('language', 'l.language')} OR l.language = 'python') AND {_LIVE}),
 cf AS (SELECT repo_id, path, line_no AS line, CASE WHEN {ex(C.METHOD_OPTION, 1, 'near')} <> '' THEN upper({ex(C.METHOD_OPTION, 1, 'near')}) ELSE 'GET' END AS method,
   {_each(_FETCH2, 1, 2, 3)} AS target, 'fetch' AS via FROM cl),
 ca AS (SELECT repo_id, path, line_no, upper(unnest(regexp_extract_all(line, {q(_AXIOS2)}, 1))), {_each(_AXIOS2, 2, 3, 4)}, 'axios' FROM cl),
 ch AS (SELECT repo_id, path, line_no, unnest(regexp_extract_all(line, {q(_API2)}, 1)) AS helper, {_each(_API2, 2, 3, 4)} AS target,
   unnest(regexp_extract_all(line, {q(_API2)}, 5)) AS payload FROM cl),
 literal_calls AS (SELECT * FROM cf UNION ALL SELECT * FROM ca),
 api_calls AS (SELECT * FROM literal_calls WHERE target LIKE '/%' UNION ALL SELECT repo_id, path, line_no, CASE WHEN lower(helper) LIKE '%delete%' THEN 'DELETE'
  WHEN lower(helper) LIKE '%patch%' THEN 'PATCH' WHEN lower(helper) LIKE '%post%' THEN 'POST' WHEN lower(helper) LIKE '%put%' THEN 'PUT'
  WHEN payload <> '' THEN 'POST' ELSE 'GET' END, target, helper FROM ch WHERE helper NOT IN ({', '.join(q(x) for x in C.NOT_HELPERS)})),
 co AS (SELECT repo_id, path, line_no, unnest(regexp_extract_all(line, {q(C.OUTBOUND)}, 1)) AS via, trim(unnest(regexp_extract_all(line, {q(C.OUTBOUND)}, 2))) AS t FROM cl),
 external_calls AS (SELECT * FROM literal_calls WHERE target NOT LIKE '/%' UNION ALL SELECT repo_id, path, line_no, '?', CASE WHEN t = '' THEN '(dynamic)'
  ELSE left(t, 120) END, via FROM co WHERE NOT regexp_matches(t, '^[''"`]/') AND NOT (regexp_matches(t, '^[''"`]') AND NOT starts_with(trim(t, '''"`'), 'http')))"""


def _call_rows(spark, sf_dir, fact):
    return C.table(parsed(spark, sf_dir, fact), fact).select("repo_id", "path", "line", "method", "target", "via")


@query("internal_api_calls", "C13", ctes(CODE, CODE_LINES, CALLS) + "SELECT * FROM api_calls")
def internal_api_calls(spark, sf_dir):
    return _call_rows(spark, sf_dir, "api_calls")


@query("outbound_calls", "C14", ctes(CODE, CODE_LINES, CALLS) + "SELECT * FROM external_calls")
def outbound_calls(spark, sf_dir):
    return _call_rows(spark, sf_dir, "external_calls")


_DM = ex(C.DATA_CALL, 2)
DATA = f"""data AS (SELECT repo_id, path, line_no AS line, CASE WHEN {rx(C.SQL_TEXT)} OR {_DM} IN ({', '.join(q(x) for x in C.SQL_METHODS)}) THEN 'sql'
 WHEN {rx(C.DOCUMENT_METHODS, _DM)} THEN 'document' ELSE 'orm' END AS kind, left({STRIP.format('line')}, 160) AS snippet FROM code_lines
 WHERE kind = 'source' AND ({rx(C.DATA_CALL)} OR {rx(C.SQL_TEXT)}))"""


@query("data_access_lines", "C15", ctes(CODE, CODE_LINES, DATA) + "SELECT * FROM data")
def data_access_lines(spark, sf_dir):
    return C.table(parsed(spark, sf_dir, "data_access"), "data_access").drop("ordinal")


MARKERS = f"""markers AS (SELECT repo_id, path, line_no AS line, left({STRIP.format('line')}, 200) AS text FROM code_lines
 WHERE kind = 'source' AND {rx(C.MARKER)})"""


@query("legacy_markers", "C16", ctes(CODE, CODE_LINES, MARKERS) + "SELECT * FROM markers")
def legacy_markers(spark, sf_dir):
    return C.table(parsed(spark, sf_dir, "markers"), "markers").drop("ordinal")


@query("dom_files", "C17", ctes(CODE, CODE_LINES) + f"""SELECT repo_id, path FROM code_lines WHERE {JS} GROUP BY 1, 2
 HAVING bool_or({rx(C.DOM_USAGE)})""")
def dom_files(spark, sf_dir):
    return parsed(spark, sf_dir, "uses_dom").where("uses_dom").select("repo_id", "path")


@query("called_identifiers", "C18", SYMBOL_BASE + f"""SELECT DISTINCT repo_id, path, line_start, unnest(regexp_extract_all(replace(array_to_string(
 lines[line_start:line_end], chr(10)), '(', '( '), {q(r'(?:^|[^\w$.])(' + C.ID + r')\s*\(')}, 1)) AS called FROM symbols JOIN code USING (repo_id, path)""")
def called_identifiers(spark, sf_dir):
    from sourcegrain.functions import text as tx
    p = parsed(spark, sf_dir, "symbols").select("repo_id", "path", "lines", F.explode("symbols").alias("s"))
    body = tx.join_lines(tx.slice_lines(F.col("lines"), F.col("s.line_start"), F.col("s.line_end")))
    return p.select("repo_id", "path", F.col("s.line_start").alias("line_start"), F.explode(C.called_identifiers(body)).alias("called"))


@query("symbol_at_line", "C19", SYMBOL_BASE + ", " + DATA + """ SELECT repo_id, path, line, name, line_start, line_end FROM (SELECT d.repo_id, d.path, d.line, s.name,
 s.line_start, s.line_end, row_number() OVER (PARTITION BY d.repo_id, d.path, d.line ORDER BY s.line_end - s.line_start, s.line_start) AS rn
 FROM data d JOIN symbols s ON s.repo_id = d.repo_id AND s.path = d.path AND d.line BETWEEN s.line_start AND s.line_end) WHERE rn = 1""")
def symbol_at_line(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    return C.innermost_symbol(C.table(p, "data_access").select("repo_id", "path", "line"), C.table(p, "symbols"))


@query("symbol_lookup", "C20", SYMBOL_BASE + f", {ROUTES}" + """, r AS (SELECT DISTINCT repo_id, path, handler AS name FROM routes WHERE handler IS NOT NULL
 UNION SELECT repo_id, 'elsewhere.js', handler FROM routes WHERE handler IS NOT NULL)
 SELECT r.repo_id, r.path, r.name, s.path AS target_path, s.line_start AS target_line FROM r LEFT JOIN LATERAL (SELECT path, line_start FROM symbols s
 WHERE s.repo_id = r.repo_id AND s.name = r.name ORDER BY s.path <> r.path, s.path, s.line_start, s.line_end DESC LIMIT 1) s ON true""")
def symbol_lookup(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    names = C.table(p, "routes").where("handler IS NOT NULL").select("repo_id", "path", F.col("handler").alias("name"))
    refs = names.unionByName(names.withColumn("path", F.lit("elsewhere.js"))).distinct()
    return C.resolve_names(refs, p).select("repo_id", "path", "name", F.col("target.path").alias("target_path"),
                                           F.col("target.line_start").alias("target_line"))


def _spans(memory_type: str, window: int, step: int, where: str) -> str:
    return f"""SELECT repo_id, path, '{memory_type}' AS memory_type FROM (SELECT repo_id, path, lines, unnest(range(0, CASE WHEN len(lines) = 0 THEN 0
  ELSE 1 + ceil(greatest(len(lines) - {window}, 0) / {step}.0)::BIGINT END)) * {step} + 1 AS a FROM code WHERE {where})
  WHERE regexp_matches(array_to_string(lines[a:a + {window - 1}], chr(10)), '\\S')"""


@query("index_passage_stats", "B3 B5 B6 B7", SYMBOL_BASE + f""", hd AS (SELECT *, regexp_matches(line, '^\\s{{0,3}}#{{1,6}}\\s+(.*)$') AS is_head FROM code_lines WHERE kind = 'doc'),
 hg AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY repo_id, path ORDER BY line_no) AS sec FROM hd),
 hs AS (SELECT *, (line_no - min(line_no) OVER (PARTITION BY repo_id, path, sec)) // 60 AS chunk FROM hg),
 pa AS (SELECT s.repo_id, s.path, 'symbol' AS memory_type FROM symbols s JOIN code c ON c.repo_id = s.repo_id AND c.path = s.path WHERE c.kind = 'source'
  UNION ALL {_spans('code', 40, 30, "kind = 'source'")} UNION ALL {_spans('config', 60, 60, "kind IN ('config', 'manifest')")}
  UNION ALL SELECT repo_id, path, 'doc' FROM hs GROUP BY repo_id, path, sec, chunk HAVING bool_or(regexp_matches(line, '\\S')))
 SELECT repo_id, memory_type, count(*) AS passages, count(DISTINCT concat(repo_id, chr(0), path)) AS files FROM pa GROUP BY ROLLUP (repo_id, memory_type)""")
def index_passage_stats(spark, sf_dir):
    from sourcegrain.operators import passages as P
    return P.index_stats(P.index(fact_table(spark, sf_dir)))


@query("symbol_passages", "B3 B4", SYMBOL_BASE + """SELECT repo_id, path, CASE WHEN parent IS NULL THEN name ELSE concat(parent, '.', name) END AS symbol, line_start,
 line_end, array_to_string(lines[line_start:line_end], chr(10)) AS content
 FROM symbols JOIN code USING (repo_id, path)""")
def symbol_passages(spark, sf_dir):
    from sourcegrain.operators import passages as P
    return P.symbol_passages(parsed(spark, sf_dir, "symbols")).select("repo_id", "path", "symbol", "line_start", "line_end", "content")


@query("window_symbol_names", "B5", SYMBOL_BASE + """, w AS (SELECT repo_id, path, len(lines) AS n, unnest(range(0, 1 + ceil(greatest(len(lines) - 12, 0) / 8.0)::BIGINT)) * 8 + 1 AS ws
 FROM code WHERE kind = 'source'), x AS (SELECT *, least(n, ws + 11) AS we FROM w),
 o AS (SELECT x.repo_id, x.path, x.ws, s.name, min((s.line_start, -s.line_end)) AS pos FROM x JOIN symbols s ON s.repo_id = x.repo_id AND s.path = x.path
  AND s.line_start <= x.we AND s.line_end >= x.ws GROUP BY 1, 2, 3, 4)
 SELECT repo_id, path, ws::INT AS line_start, string_agg(name, ' ' ORDER BY pos) AS names FROM o GROUP BY 1, 2, 3""")
def window_symbol_names(spark, sf_dir):
    from sourcegrain.operators import passages as P
    w = P.windows(parsed(spark, sf_dir, "symbols").where("kind = 'source'"), window=12, step=8)
    return w.where("extra <> ''").select("repo_id", "path", "line_start", F.col("extra").alias("names"))
