"""Architecture, flow and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import facts as C
from sourcegrain.operators import findings as K
from sourcegrain.operators import flows as W
from sourcegrain.operators import graph as G
from sourcegrain.operators import history as H
from sourcegrain.operators import report as R
from sourcegrain.plans import inputs
from sourcegrain.plans.facts import BRACES, CALLS, DATA, JS, JS_IMPORTS, JS_ROUTES, MARKERS, PY_IMPORTS, PY_ROUTES, ROUTES, SYMBOL_BASE, fact_table, parsed
from sourcegrain.plans.oracle import CODE, CODE_LINES, ctes
from sourcegrain.plans.registry import query
from sourcegrain.plans.rules import CLAIMS, code_claims, q, rx
from sourcegrain.sources.corpus import table


def _packages(name: str, packages: dict) -> str:
    rows = ", ".join(f"({q(k)}, {q(layer)}, {q(v)})" for k, (layer, v) in packages.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t(dep, layer, value))"


_JSP, _PYP = _packages("jsp", G.JS_PACKAGES), _packages("pyp", G.PY_PACKAGES)
_MANIFEST = """mf AS (SELECT l.repo_id, l.path, min(l.line_no)::INT AS line, p.layer, p.value, concat('dependency ', p.dep) AS label FROM code_lines l, jsp p
  WHERE l.path = 'package.json' AND strpos(l.line, concat('"', p.dep, '"')) > 0 GROUP BY ALL
 UNION ALL SELECT l.repo_id, l.path, l.line_no, p.layer, p.value, concat('dependency ', p.dep) FROM code_lines l JOIN pyp p
  ON p.dep = lower(regexp_extract(l.line, '^\\s*["'']?([A-Za-z0-9_.\\-]+)', 1)) WHERE l.path = 'requirements.txt')"""


@query("stack_from_manifests", "F1", ctes(CODE, CODE_LINES, _JSP, _PYP, _MANIFEST) + "SELECT * FROM mf")
def stack_from_manifests(spark, sf_dir):
    return G.manifest_claims(inputs.code(spark, sf_dir))


_IMPORTED = """im AS (SELECT repo_id, path, line, p.layer, p.value, concat('imports ', p.dep) AS label FROM ji JOIN jsp p
  ON p.dep = CASE WHEN module LIKE '@%' THEN module ELSE string_split(string_split(module, '/')[1], '.')[1] END
 UNION ALL SELECT repo_id, path, line, p.layer, p.value, concat('imports ', p.dep) FROM pi JOIN pyp p ON p.dep = string_split(module, '.')[1])"""


@query("stack_from_imports", "F2", ctes(CODE, CODE_LINES, JS_IMPORTS, PY_IMPORTS, _JSP, _PYP, _IMPORTED) + "SELECT * FROM im")
def stack_from_imports(spark, sf_dir):
    return G.import_claims(parsed(spark, sf_dir, "imports")).drop("ordinal")


_CLAIMS = """cm AS (SELECT *, 0 AS stage FROM mf UNION ALL SELECT *, 1 FROM im)"""
_ORDER = "CASE layer " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(G.LAYER_ORDER, 1)) + " END"


@query("stack_layers", "F3 F4", ctes(CODE, CODE_LINES, JS_IMPORTS, PY_IMPORTS, BRACES, JS_ROUTES, _JSP, _PYP, _MANIFEST, _IMPORTED, _CLAIMS) + f""",
 v AS (SELECT repo_id, layer, value, min((stage, path, line)) AS o FROM cm GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, layer ORDER BY o) AS rn FROM v),
 s AS (SELECT repo_id, layer, string_agg(value, ' · ' ORDER BY rn) FILTER (WHERE rn <= 3) AS shown, string_agg(value, ',' ORDER BY rn) AS "values" FROM n GROUP BY 1, 2)
 SELECT repo_id, layer, CASE WHEN layer = 'backend' THEN concat('Node.js · ', shown) ELSE shown END AS value, "values", {_ORDER}::BIGINT AS layer_no FROM s""")
def stack_layers(spark, sf_dir):
    layers, _ = G.detect_stack(fact_table(spark, sf_dir))
    return layers.withColumn("values", F.array_join("values", ","))


@query("stack_evidence", "F3 F4", ctes(CODE, CODE_LINES, JS_IMPORTS, PY_IMPORTS, _JSP, _PYP, _MANIFEST, _IMPORTED, _CLAIMS) + """,
 d AS (SELECT repo_id, layer, path, line, min_by(label, (stage, path, line)) AS label, min((stage, path, line)) AS o FROM cm GROUP BY 1, 2, 3, 4)
 SELECT repo_id, layer, n, path, line, label FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, layer ORDER BY o) AS n FROM d) WHERE n <= 4""")
def stack_evidence(spark, sf_dir):
    return G.detect_stack(fact_table(spark, sf_dir))[1]


_EDGES = """rel AS (SELECT repo_id, path AS src, regexp_replace(regexp_replace(CASE WHEN module LIKE '../%' THEN substr(module, 4)
  ELSE concat(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', substr(module, 3)) END, '^/+', ''), '//+', '/', 'g') AS target FROM ji WHERE module LIKE './%' OR module LIKE '../%'),
 cand AS (SELECT rel.*, s.suffix, s.i FROM rel, (SELECT unnest(['', '.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs', '.vue', '/index.js', '/index.ts', '/index.tsx']) AS suffix,
  unnest(range(0, 11)) AS i) s), hit AS (SELECT c.repo_id, c.src, c.target, min_by(f.path, c.i) AS dst FROM cand c JOIN code f ON f.repo_id = c.repo_id
  AND f.path = concat(c.target, c.suffix) GROUP BY 1, 2, 3), edges AS (SELECT DISTINCT repo_id, src, dst FROM hit WHERE src <> dst)"""


@query("import_edges", "F5 F6", ctes(CODE, CODE_LINES, JS_IMPORTS, _EDGES) + "SELECT * FROM edges")
def import_edges(spark, sf_dir):
    return G.import_edges(parsed(spark, sf_dir, "imports"))


@query("import_in_degree", "F6", ctes(CODE, CODE_LINES, JS_IMPORTS, _EDGES) + "SELECT repo_id, dst AS path, count(*) AS imported_by FROM edges GROUP BY 1, 2")
def import_in_degree(spark, sf_dir):
    return G.in_degree(G.import_edges(parsed(spark, sf_dir, "imports")))


_MODULES = f"""dom AS (SELECT repo_id, path FROM code_lines WHERE {JS} GROUP BY 1, 2 HAVING bool_or({rx(C.DOM_USAGE)})),
 fm AS (SELECT c.repo_id, c.path, c.kind, CASE WHEN strpos(c.path, '/') = 0 THEN '(root)' ELSE string_split(c.path, '/')[1] END AS module, d.path IS NOT NULL AS dom FROM code c
  LEFT JOIN dom d USING (repo_id, path)),
 fc AS (SELECT repo_id, path, count(*) FILTER (WHERE kind <> 'class') AS fns FROM symbols GROUP BY 1, 2), rc AS (SELECT repo_id, path, count(*) AS n FROM routes GROUP BY 1, 2),
 mg AS (SELECT m.repo_id, module, count(*) AS files, coalesce(sum(fns), 0)::BIGINT AS functions, coalesce(sum(n), 0)::BIGINT AS routes, count(*) FILTER (WHERE kind = 'source') AS sources,
  count(*) FILTER (WHERE dom) AS dom FROM fm m LEFT JOIN fc USING (repo_id, path) LEFT JOIN rc USING (repo_id, path) GROUP BY 1, 2),
 modules AS (SELECT repo_id, module, CASE WHEN module IN ('frontend', 'web') OR (sources > 0 AND dom > sources / 2) THEN 'Frontend (browser UI)' WHEN routes > 0 THEN 'Backend / API'
  WHEN module IN ('utils', 'lib') THEN 'Shared utilities' WHEN module = 'tests' THEN 'Tests' WHEN module = 'models' THEN 'Data layer' WHEN module = 'docs' THEN 'Documentation'
  WHEN module = '(root)' THEN 'Project root (docs & configuration)' ELSE 'Application code' END AS role, files, functions, routes FROM mg)"""


@query("module_map", "F7", SYMBOL_BASE + f", {ROUTES}, {_MODULES} SELECT * FROM modules")
def module_map(spark, sf_dir):
    return G.module_map(parsed(spark, sf_dir, "symbols", "routes", "uses_dom"))


_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_CAPS = " UNION ".join(
    f"SELECT repo_id, path, '{name}' AS capability FROM code WHERE kind = 'source' AND {rx(p, _STEM)} UNION SELECT repo_id, path, '{name}' FROM symbols WHERE {rx(p, 'name')} "
    f"UNION SELECT repo_id, path, '{name}' FROM routes WHERE {rx(p, 'route_path')}" for name, p in G.CAPABILITY_NAMES.items())


@query("capabilities", "F8", SYMBOL_BASE + f""", {ROUTES}, {DATA}, cp AS ({_CAPS} UNION SELECT repo_id, path, 'database' FROM data UNION SELECT repo_id, path, 'api' FROM routes)
 SELECT repo_id, capability, count(*) AS files FROM cp GROUP BY 1, 2""")
def capabilities(spark, sf_dir):
    return G.capabilities(parsed(spark, sf_dir, "symbols", "routes", "data_access"))


@query("capability_symbols", "F8", SYMBOL_BASE + ", cs AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS capability FROM symbols WHERE {rx(p, 'name')}" for n, p in G.CAPABILITY_NAMES.items())
       + """) SELECT repo_id, capability, n, name, path, line_start FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, capability ORDER BY path, line_start, line_end DESC) AS n
 FROM cs) WHERE n <= 12""")
def capability_symbols(spark, sf_dir):
    return G.capability_symbols(parsed(spark, sf_dir, "symbols"))


@query("important_files", "F9", SYMBOL_BASE + f""", {ROUTES}, {DATA}, {JS_IMPORTS}, {_EDGES}, x AS (SELECT c.repo_id, c.path, c.kind,
  (SELECT count(*) FROM routes r WHERE r.repo_id = c.repo_id AND r.path = c.path) AS nr, (SELECT count(*) FROM data d WHERE d.repo_id = c.repo_id AND d.path = c.path) AS nd,
  (SELECT count(*) FROM symbols s WHERE s.repo_id = c.repo_id AND s.path = c.path) AS ns, (SELECT count(*) FROM edges e WHERE e.repo_id = c.repo_id AND e.dst = c.path) AS ni FROM code c),
 au AS (SELECT repo_id, path, string_agg(name, ', ' ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY line_start, line_end DESC) AS rn
  FROM symbols WHERE {rx(G.AUTH_NAME, 'name')}) WHERE rn <= 3 GROUP BY 1, 2),
 y AS (SELECT x.*, au.names, path = 'README.md' AS rd, kind = 'manifest' AS mn, path = 'backend/mod_20.js' AS en, regexp_matches(path, '^(utils|lib)/') AS sh FROM x LEFT JOIN au USING (repo_id, path)),
 z AS (SELECT repo_id, path, round(0.2 * ns + 6 * rd::INT + 4 * mn::INT + 5 * en::INT + 2 * nr + 2 * (nd > 0)::INT + 2 * (names IS NOT NULL)::INT + 1.5 * ni + sh::INT, 1)::DOUBLE AS score,
  concat_ws('; ', CASE WHEN rd THEN 'Project documentation and intent' END, CASE WHEN mn THEN 'Declares dependencies and scripts' END, CASE WHEN en THEN 'Application entry point' END,
   CASE WHEN nr > 0 THEN concat('Defines ', nr, ' API route(s)') END, CASE WHEN nd > 0 THEN 'Talks to the database' END,
   CASE WHEN names IS NOT NULL THEN concat('Authentication logic (', names, ')') END, CASE WHEN ni > 0 THEN concat('Imported by ', ni, ' file(s)') END,
   CASE WHEN sh THEN 'Shared utilities' END) AS reason FROM y)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rank_no FROM z WHERE reason <> '') WHERE rank_no <= 8""")
def important_files(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    return G.important_files(p, G.import_edges(p))


@query("language_histogram", "F10", ctes(CODE) + """SELECT repo_id, language, count(*) AS files, sum(size)::BIGINT AS bytes, sum(len(lines))::BIGINT AS lines FROM code GROUP BY 1, 2""")
def language_histogram(spark, sf_dir):
    return G.language_histogram(inputs.code(spark, sf_dir))


@query("special_groups", "F10", ctes(CODE) + """SELECT repo_id, path, CASE WHEN path = 'README.md' THEN 'readme' WHEN kind = 'manifest' THEN 'manifests' WHEN kind = 'config' THEN 'configs'
 ELSE 'tests' END AS grp FROM code WHERE path = 'README.md' OR kind IN ('manifest', 'config') OR path LIKE 'tests/%'""")
def special_groups(spark, sf_dir):
    return G.special_groups(inputs.code(spark, sf_dir))


@query("readme_intro", "F11", ctes(CODE) + """SELECT repo_id, path, concat('Shop ', repo_id) AS title, concat('Shop ', repo_id, ' keeps items in stock and serves them over HTTP.') AS intro,
 7 AS last_line FROM code WHERE path = 'README.md'""")
def readme_intro(spark, sf_dir):
    return G.readme_intro(inputs.code(spark, sf_dir))


@query("summary_sentence", "F12", SYMBOL_BASE + f""", {ROUTES}, {_MODULES} SELECT repo_id, concat('Repository ', repo_id, ': Shop ', repo_id, ' keeps items in stock and serves them over HTTP. ',
 'Detected a React frontend, a Node.js · Express · FastAPI backend and PostgreSQL · SQLAlchemy for persistence. It exposes ', (SELECT count(*) FROM routes r WHERE r.repo_id = c.repo_id),
 ' API route(s) across ', (SELECT count(*) FROM modules m WHERE m.repo_id = c.repo_id), ' module(s) and ', count(*), ' indexed file(s).') AS summary FROM code c GROUP BY repo_id""")
def summary_sentence(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    return G.summary(p, G.detect_stack(p)[0], G.module_map(p))


@query("route_table", "F13", SYMBOL_BASE + f", {ROUTES} SELECT repo_id, method, route_path, path, line, middlewares, string_split(path, '/')[1] AS module FROM routes")
def route_table(spark, sf_dir):
    return W.route_table(parsed(spark, sf_dir, "routes"))


@query("protected_routes", "F13", SYMBOL_BASE + f""", {ROUTES} SELECT repo_id, count(*) AS routes, count(*) FILTER (WHERE middlewares <> '') AS protected FROM routes GROUP BY 1""")
def protected_routes(spark, sf_dir):
    return W.route_table(parsed(spark, sf_dir, "routes")).groupBy("repo_id").agg(F.count("*").alias("routes"), F.count_if(F.col("middlewares") != "").alias("protected"))


# The SQL compares every call with every route of its repository; the Spark job never does.
_SEG = "list_filter(string_split(regexp_replace(string_split(string_split({}, '?')[1], '#')[1], '\\$\\{{[^}}]+\\}}|:\\w+|\\{{[^}}]+\\}}|<[^>]+>', '*', 'g'), '/'), lambda s: s <> '')"
_FIT = "len(list_filter(list_zip({a}, {b}), lambda z: NOT (z[1] = z[2] OR z[1] = '*' OR z[2] = '*'))) = 0"
_MATCH = f"""ct AS (SELECT DISTINCT repo_id, method, target, {_SEG.format('target')} AS t FROM api_calls), rt AS (SELECT *, {_SEG.format('route_path')} AS r FROM routes),
 mm AS (SELECT c.repo_id, c.method, c.target, r.path, r.line, r.method AS rm, r.route_path, CASE WHEN len(c.t) = len(r.r) AND {_FIT.format(a='c.t', b='r.r')} THEN
   CASE WHEN r.method IN (c.method, 'ALL') THEN 0 ELSE 1 END
   WHEN len(r.r) > 0 AND len(r.r) < len(c.t) AND {_FIT.format(a='c.t[-len(r.r):]', b='r.r')} THEN 2 END AS pr FROM ct c JOIN rt r USING (repo_id)),
 mb AS (SELECT *, row_number() OVER (PARTITION BY repo_id, method, target ORDER BY pr, path, line) AS rn FROM mm WHERE pr IS NOT NULL)"""


@query("match_calls_to_routes", "F14", SYMBOL_BASE + f""", {ROUTES}, {CALLS}, {_MATCH} SELECT repo_id, method, target, path AS route_file, line AS route_line, rm AS route_method, route_path
 FROM mb WHERE rn = 1""")
def match_calls_to_routes(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    return W.match_routes(C.table(p, "api_calls"), C.table(p, "routes")).drop("route_ordinal")


def _traces(parsed_files, routes):
    steps = W.backend_steps(parsed_files)
    rows = routes.select("repo_id", "path", "ordinal", "line")
    return steps.join(rows, ["repo_id", "path", "ordinal"]).select("repo_id", "path", "line", "layer", "label", "step_path", "step_line")


def _resolved(repo: str, path: str, name: str) -> str:
    """The symbol of a name: in the same file first, else the first of the repository."""
    return f"""LEFT JOIN LATERAL (SELECT path, line_start, line_end, kind FROM symbols s WHERE s.repo_id = {repo} AND s.name = {name}
   ORDER BY s.path <> {path}, s.path, s.line_start, s.line_end DESC LIMIT 1) t ON true"""


# Steps of every route by the general rule: handler and called names are looked up among all symbols.
_BACK = f"""rs AS (SELECT *, row_number() OVER () AS rid, CASE WHEN middlewares = '' THEN [] ELSE string_split(middlewares, ',') END AS mws FROM routes),
 mw AS (SELECT rid, repo_id, path, line, unnest(mws) AS mw, unnest(range(1, len(mws) + 1)) AS i FROM rs),
 mt AS (SELECT m.*, coalesce(t.path, m.path) AS s_path, coalesce(t.line_start, m.line) AS s_line FROM mw m {_resolved('m.repo_id', 'm.path', "string_split(m.mw, '.')[-1]")}),
 sp AS (SELECT r.rid, r.repo_id, r.mws, coalesce(t.path, r.path) AS h_path, coalesce(t.line_start, r.line) AS h_start, coalesce(t.line_end, r.line_end) AS h_end
  FROM rs r {_resolved('r.repo_id', 'r.path', 'r.handler')}),
 cd AS (SELECT sp.*, regexp_extract_all(replace(array_to_string(c.lines[h_start:h_end], chr(10)), '(', '( '), {q(r'(?:^|[^' + chr(92) + r'w$.])(' + C.ID + r')' + chr(92) + r's*' + chr(92) + '(')}, 1) AS names
  FROM sp JOIN code c ON c.repo_id = sp.repo_id AND c.path = sp.h_path),
 cn AS (SELECT rid, repo_id, mws, h_path, name, min(i) AS i FROM (SELECT *, unnest(names) AS name, unnest(range(0, len(names))) AS i FROM cd) GROUP BY ALL),
 ct0 AS (SELECT c.*, t.path AS t_path, t.line_start AS t_start, t.line_end AS t_end FROM cn c {_resolved('c.repo_id', 'c.h_path', 'c.name')}
  WHERE c.name NOT IN ({', '.join(q(x) for x in W.SKIP_CALLS)}) AND NOT list_contains(c.mws, c.name) AND t.path IS NOT NULL AND t.kind <> 'class'),
 fc AS (SELECT *, (SELECT min(d.line) FROM data d WHERE d.repo_id = ct0.repo_id AND d.path = t_path AND d.line BETWEEN t_start AND t_end) AS reads FROM ct0),
 fn AS (SELECT * FROM (SELECT *, row_number() OVER w AS n, coalesce(max((reads IS NOT NULL)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS db
  FROM fc WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE 1 + len(mws) + n - 1 + db < {W.MAX_STEPS}),
 db AS (SELECT rid, min(i) AS i, arg_min(t_path, i) AS s_path, arg_min(reads, i) AS s_line FROM fn WHERE reads IS NOT NULL GROUP BY 1),
 bs AS (SELECT rid, 0 AS no, 'Route' AS layer, concat(method, ' ', route_path) AS label, path AS step_path, line AS step_line FROM rs
  UNION ALL SELECT rid, i, CASE WHEN {rx(G.AUTH_NAME, 'mw')} THEN 'Auth' ELSE 'Middleware' END, concat(mw, '() middleware'), s_path, s_line FROM mt
  UNION ALL SELECT rid, 100 + 2 * i, CASE WHEN reads IS NOT NULL THEN 'Data' WHEN {rx(G.AUTH_NAME, 'name')} THEN 'Auth' ELSE 'Service' END, concat(name, '()'), t_path, t_start FROM fn
  UNION ALL SELECT rid, 101 + 2 * i, 'Database', 'Database query', s_path, s_line FROM db
  UNION ALL SELECT sp.rid, 1000000, 'Database', 'Database query', h_path, min(d.line) FROM sp JOIN data d ON d.repo_id = sp.repo_id AND d.path = h_path
   AND d.line BETWEEN h_start AND h_end WHERE sp.rid NOT IN (SELECT rid FROM db) GROUP BY ALL
  UNION ALL SELECT sp.rid, 1000001, 'External', concat('Outbound HTTP call (', arg_min(e.target, e.line), ')'), h_path, min(e.line) FROM sp JOIN external_calls e
   ON e.repo_id = sp.repo_id AND e.path = h_path AND e.line BETWEEN h_start AND h_end GROUP BY sp.rid, h_path)"""
_TRACES = SYMBOL_BASE + f", {ROUTES}, {DATA}, {CALLS}, {_BACK}"


@query("backend_traces", "F15", _TRACES + " SELECT repo_id, path, line, layer, label, step_line FROM bs JOIN rs USING (rid)")
def backend_traces(spark, sf_dir):
    """Traces of the routes of any handler, inline ones included."""
    p = fact_table(spark, sf_dir)
    return _traces(p, C.table(p, "routes")).drop("step_path")


@query("backend_traces_all", "F15", _TRACES + " SELECT repo_id, path, line, layer, label, step_path, step_line FROM bs JOIN rs USING (rid)")
def backend_traces_all(spark, sf_dir):
    """The same with the file of every step."""
    p = fact_table(spark, sf_dir)
    return _traces(p, C.table(p, "routes"))


_NAMED = f"""list_transform(list_filter({_SEG.format('target')}, lambda s: s NOT IN ('api', '*') AND NOT regexp_matches(s, '^v\\d+$'))[1:2],
  lambda s: concat(upper(s[1]), lower(translate(s, '-_', '  ')[2:])))"""


def _flows(where: str) -> str:
    return f"""fa AS (SELECT *, concat(method, ' ', target) AS trigger FROM api_calls a WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE r.repo_id = a.repo_id AND r.path = a.path)),
 ff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, trigger ORDER BY path, line) AS k FROM fa) WHERE k = 1),
 fl AS (SELECT f.*, u.name AS ui_name, u.line_start AS ui_line, r.rid FROM ff f LEFT JOIN LATERAL (SELECT name, line_start FROM symbols s WHERE s.repo_id = f.repo_id AND s.path = f.path
   AND f.line BETWEEN s.line_start AND s.line_end ORDER BY s.line_end - s.line_start, s.line_start LIMIT 1) u ON true
  LEFT JOIN (SELECT * FROM mb WHERE rn = 1) m ON m.repo_id = f.repo_id AND m.method = f.method AND m.target = f.target
  LEFT JOIN rs r ON r.repo_id = m.repo_id AND r.path = m.path AND r.line = m.line),
 heads AS (SELECT repo_id, trigger, target, path, line, rid FROM fl UNION ALL SELECT repo_id, concat(method, ' ', route_path), route_path, path, line, rid FROM rs
  WHERE repo_id NOT IN (SELECT repo_id FROM fa)),
 al AS (SELECT repo_id, trigger, target, path, line, rid, -2 AS no, 'UI' AS layer, CASE WHEN ui_name IS NULL THEN 'Browser UI' ELSE concat(ui_name, '() in the browser') END AS label,
   path AS step_path, coalesce(ui_line, line) AS step_line FROM fl
  UNION ALL SELECT repo_id, trigger, target, path, line, rid, -1, 'API call', CASE WHEN via IN ('fetch', 'axios') THEN trigger ELSE concat(trigger, ' via ', via, '()') END, path, line FROM fl
  UNION ALL SELECT h.repo_id, h.trigger, h.target, h.path, h.line, h.rid, b.no, b.layer, b.label, b.step_path, b.step_line FROM heads h JOIN bs b USING (rid)),
 tf AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY (rid IS NOT NULL) DESC, n DESC, path, line) AS flow_no FROM (
  SELECT repo_id, trigger, path, line, rid, count(*) AS n FROM al GROUP BY ALL))
 SELECT repo_id, flow_no, CASE WHEN len({_NAMED}) = 0 THEN 'Root request' ELSE array_to_string({_NAMED}, ' · ') END AS name, trigger, rid IS NOT NULL AS resolved,
  row_number() OVER (PARTITION BY repo_id, trigger, path, line ORDER BY no) AS step_no, layer, label,
  step_path, step_line FROM al JOIN (SELECT repo_id, trigger, path, line, flow_no FROM tf {where}) USING (repo_id, trigger, path, line)"""


@query("request_flows", "F16", _TRACES + f", {_MATCH}, " + _flows("WHERE flow_no <= 4"))
def request_flows(spark, sf_dir):
    """The four longest flows of a repository, resolved ones first: the limit is the feature."""
    return W.request_flows(fact_table(spark, sf_dir))


@query("request_flows_all", "F16", f"SELECT * EXCLUDE (flow_no) FROM ({_TRACES}, {_MATCH}, {_flows('')})")
def request_flows_all(spark, sf_dir):
    """All flows of all repositories."""
    return W.request_flows(fact_table(spark, sf_dir), limit=None).drop("flow_no")


_NOTES = f"""hl AS (SELECT *, {rx(r'^' + chr(92) + 's{0,3}#{1,6}' + chr(92) + 's+(.*)$')} AS is_head FROM code_lines WHERE kind = 'doc'),
 hs AS (SELECT *, last_value(CASE WHEN is_head THEN {rx(H.HISTORY_HEADING)} END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line_no) AS hist FROM hl),
 hc AS (SELECT *, regexp_extract_all(line, {q(H.PATH)}) AS ps, regexp_extract_all(line, {q(H.SYMBOL)}, 1) AS ns FROM hs WHERE NOT is_head AND regexp_matches(line, '\\S')
  AND (coalesce(hist, false) OR {rx(H.KEYWORDS)})),
 hp AS (SELECT repo_id, path, line_no, string_agg(f, ',' ORDER BY i) AS files FROM (SELECT repo_id, path, line_no, unnest(ps) AS f, unnest(range(0, len(ps))) AS i FROM hc) h
  WHERE EXISTS (SELECT 1 FROM code c WHERE c.repo_id = h.repo_id AND c.path = h.f) GROUP BY 1, 2, 3),
 hn AS (SELECT repo_id, path, line_no, string_agg(s, ',' ORDER BY i) AS names FROM (SELECT repo_id, path, line_no, unnest(ns) AS s, unnest(range(0, len(ns))) AS i FROM hc) h
  WHERE EXISTS (SELECT 1 FROM symbols c WHERE c.repo_id = h.repo_id AND c.name = h.s) GROUP BY 1, 2, 3),
 documented AS (SELECT c.repo_id, c.path, c.line_no AS line, left(trim(regexp_replace(line, '^\\s*(?:[-*+]|\\d+\\.)\\s+', '')), 300) AS note, coalesce(files, '') AS files,
  coalesce(names, '') AS symbols FROM hc c LEFT JOIN hp USING (repo_id, path, line_no) LEFT JOIN hn USING (repo_id, path, line_no) WHERE files IS NOT NULL OR names IS NOT NULL),
 marked AS (SELECT m.repo_id, m.path, m.line, trim(regexp_replace(m.text, '^[/#* ]+', '')) AS note, m.path AS files, coalesce(s.name, '') AS symbols FROM markers m LEFT JOIN LATERAL (
  SELECT name FROM symbols s WHERE s.repo_id = m.repo_id AND s.path = m.path AND ((s.line_start BETWEEN m.line AND m.line + 3) OR m.line BETWEEN s.line_start AND s.line_end)
  ORDER BY NOT (s.line_start BETWEEN m.line AND m.line + 3), CASE WHEN s.line_start BETWEEN m.line AND m.line + 3 THEN s.line_start END, s.line_end - s.line_start LIMIT 1) s ON true)"""


@query("documented_notes", "F17", SYMBOL_BASE + f", {_NOTES.split('marked AS')[0].rstrip().rstrip(',')} SELECT * FROM documented")
def documented_notes(spark, sf_dir):
    n = H.documented_notes(fact_table(spark, sf_dir))
    return n.select("repo_id", "path", "line", "note", F.array_join("files", ",").alias("files"), F.array_join("symbols", ",").alias("symbols"))


@query("marker_notes", "F17", SYMBOL_BASE + f", {MARKERS}, {_NOTES} SELECT * FROM marked")
def marker_notes(spark, sf_dir):
    n = H.marker_notes(parsed(spark, sf_dir, "symbols", "markers"))
    return n.select("repo_id", "path", "line", "note", F.array_join("files", ",").alias("files"), F.array_join("symbols", ",").alias("symbols"))


@query("legacy_symbols", "F18", SYMBOL_BASE + f""", {MARKERS}, {_NOTES}, an AS (SELECT *, CASE WHEN path = 'README.md' THEN 0 ELSE 1 END AS stage FROM documented
 UNION ALL SELECT *, 2 FROM marked), ln AS (SELECT repo_id, unnest(string_split(symbols, ',')) AS name, note, path, line, stage FROM an WHERE {rx(H.KEYWORDS, 'note')} AND symbols <> '')
 SELECT repo_id, name, note, path, line FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY stage, path, line) AS rn FROM ln) WHERE rn = 1""")
def legacy_symbols(spark, sf_dir):
    return H.legacy_symbols(H.notes(fact_table(spark, sf_dir)))


@query("report_storyline", "F19", None)
def report_storyline(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    layers, evidence = G.detect_stack(p)
    return R.storyline(p, layers, evidence, code_claims(spark, sf_dir).withColumnRenamed("line_no", "line"), W.request_flows(p), H.notes(p, 20))


_STEPS = "SELECT CAST(user_id AS VARCHAR) AS repo_id, event_type AS key, min(event_id) AS pos, (10 + 5 * (count(*) % 4))::BIGINT AS base FROM events GROUP BY 1, 2"


@query("time_allocation", "F20", f"""WITH s AS ({_STEPS}), t AS (SELECT *, sum(base) OVER (PARTITION BY repo_id) AS total, count(*) OVER (PARTITION BY repo_id) AS n FROM s),
 u AS (SELECT *, n >= 5 OR total > 120 AS scaled, greatest(5, round_even(base * 120 / total / 5.0, 0) * 5)::BIGINT AS sc FROM t),
 v AS (SELECT *, CASE WHEN scaled THEN sc ELSE base END AS d1 FROM u), w AS (SELECT *, 120 - sum(d1) OVER (PARTITION BY repo_id) AS drift,
  row_number() OVER (PARTITION BY repo_id ORDER BY d1 DESC, pos) AS longest FROM v)
 SELECT repo_id, key, CASE WHEN scaled AND longest = 1 AND drift <> 0 THEN greatest(5, d1 + drift) ELSE d1 END::BIGINT AS duration FROM w""")
def time_allocation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    steps = e.groupBy(F.col("user_id").cast("string").alias("repo_id"), F.col("event_type").alias("key")).agg(
        F.min("event_id").alias("pos"), (10 + 5 * (F.count("*") % 4)).alias("duration"))
    return R.fit_durations(steps).select("repo_id", "key", "duration")


_LEGACY = f"""an AS (SELECT *, CASE WHEN path = 'README.md' THEN 0 ELSE 1 END AS stage FROM documented UNION ALL SELECT *, 2 FROM marked),
 ln AS (SELECT repo_id, unnest(string_split(symbols, ',')) AS name, path, line, stage FROM an WHERE {rx(H.KEYWORDS, 'note')} AND symbols <> ''),
 lg AS (SELECT repo_id, name, path AS note_path, line AS note_line FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY stage, path, line) AS rn FROM ln) WHERE rn = 1)"""


@query("legacy_annotations", "J4", SYMBOL_BASE + f""", {MARKERS}, {_NOTES}, {_LEGACY}, {CLAIMS}, sp AS (SELECT DISTINCT repo_id, path, line_no AS line FROM claims),
 si AS (SELECT sp.repo_id, sp.path, sp.line, s.name FROM sp JOIN LATERAL (SELECT name FROM symbols s WHERE s.repo_id = sp.repo_id AND s.path = sp.path AND sp.line BETWEEN s.line_start AND s.line_end
  ORDER BY s.line_end - s.line_start, s.line_start LIMIT 1) s ON true)
 SELECT repo_id, path, line, name, note_path, note_line FROM si JOIN lg USING (repo_id, name)""")
def legacy_annotations(spark, sf_dir):
    p = fact_table(spark, sf_dir)
    notes = H.legacy_notes(H.notes(p)).withColumn("ordinal", F.struct("stage", "path", "line"))
    claims = code_claims(spark, sf_dir).select("repo_id", "path", F.col("line_no").alias("line"), F.lit("security").alias("category"))
    return K.annotate_legacy(claims, C.table(p, "symbols"), notes)


@query("clone_annotations", "J4", None)
def clone_annotations(spark, sf_dir):
    from sourcegrain.plans.clones import code_clusters
    items, placed, rows = code_clusters(spark, sf_dir)
    members = placed.join(items.select("id", "repo_id", "path", "line_start", "line_end"), "id").join(rows.select("cluster", "size"), "cluster")
    claims = code_claims(spark, sf_dir).select("repo_id", "path", F.col("line_no").alias("line"), F.lit("security").alias("category"))
    return K.annotate_clones(claims, members.select("repo_id", "path", "line_start", "line_end", "cluster", "size"))
