"""Duplicate-detection queries: documents by word shingles, functions by token shingles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import similarity as S
from sourcegrain.plans import inputs
from sourcegrain.plans.oracle import DOCS, ctes
from sourcegrain.plans.registry import query
from sourcegrain.sources.corpus import spread, table

WORD = r"[\p{L}\p{N}]+"


SQL_WORDS = 25  # floor of the queries that look at longer documents only; those named _all have none


def doc_items(spark, sf_dir, min_words: int | None = None):
    """id, n_tokens and word 5-shingles of the documents that have words, at least ``min_words`` if given."""
    d = spread(table(spark, sf_dir, "documents"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    d = d.select(F.col("doc_id").alias("id"), words.alias("t")).where(F.size("t") >= (min_words or 1))
    return d.select("id", F.size("t").alias("n_tokens"), S.shingles(F.col("t")).alias("shingles"))


# Brute force in SQL: every shingle pair, independent of the prefix filter.
ITEMS = f"""items AS (SELECT doc_id AS id, w, len(w) AS n_tokens, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
 list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents) WHERE len(w) >= {SQL_WORDS}),
 keyed AS (SELECT *, md5(concat(n_tokens, ':', array_to_string(list_sort(sh), '|'))) AS k FROM items),
 grp AS (SELECT k, min(id) AS rep, count(*) AS n_copies FROM keyed GROUP BY k),
 reps AS (SELECT g.rep, g.n_copies, i.n_tokens, i.sh FROM grp g JOIN keyed i ON i.id = g.rep),
 ex AS (SELECT rep, len(sh) AS n, n_tokens, unnest(sh) AS s FROM reps),
 inter AS (SELECT a.rep AS rep_a, b.rep AS rep_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb,
  any_value(a.n_tokens) AS ta, any_value(b.n_tokens) AS tb FROM ex a JOIN ex b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
 pairs AS (SELECT rep_a, rep_b, c / (na + nb - c) AS score FROM inter WHERE c / (na + nb - c) >= 0.72
  AND least(ta, tb) / greatest(ta, tb) >= 0.6)"""
COMPONENTS = """reach AS (WITH RECURSIVE und AS (SELECT rep_a AS a, rep_b AS b FROM pairs UNION SELECT rep_b, rep_a FROM pairs),
 r AS (SELECT rep AS node, rep AS seen FROM reps UNION SELECT r.node, und.b FROM r JOIN und ON und.a = r.seen) SELECT * FROM r),
 label AS (SELECT node AS rep, min(seen) AS cluster FROM reach GROUP BY 1),
 rows1 AS (SELECT cluster, sum(n_copies)::BIGINT AS size, sum(n_copies * (n_copies - 1) / 2) AS w FROM reps JOIN label USING (rep) GROUP BY 1),
 rows2 AS (SELECT l.cluster, sum(p.score * a.n_copies * b.n_copies) AS es, sum(a.n_copies * b.n_copies) AS ew FROM pairs p
  JOIN label l ON l.rep = p.rep_a JOIN reps a ON a.rep = p.rep_a JOIN reps b ON b.rep = p.rep_b GROUP BY 1),
 clusters AS (SELECT cluster, size, (w + coalesce(ew, 0))::BIGINT AS edges, (w + coalesce(es, 0)) / (w + coalesce(ew, 0)) AS similarity
  FROM rows1 LEFT JOIN rows2 USING (cluster) WHERE size >= 2),
 placed AS (SELECT k.id, g.rep, l.cluster FROM keyed k JOIN grp g USING (k) JOIN label l ON l.rep = g.rep JOIN clusters USING (cluster))"""


ITEMS_ALL = ITEMS.replace(f"len(w) >= {SQL_WORDS}", "len(w) >= 1", 1)


@query("word_shingles", "E3", "WITH " + ITEMS + " SELECT id, n_tokens::BIGINT AS n_tokens, len(sh) AS n_shingles FROM items")
def word_shingles(spark, sf_dir):
    return doc_items(spark, sf_dir, SQL_WORDS).select("id", "n_tokens", F.size("shingles").alias("n_shingles"))


@query("similar_document_pairs", "E4 E5", "WITH " + ITEMS + " SELECT rep_a, rep_b, round(score, 6) AS score FROM pairs")
def similar_document_pairs(spark, sf_dir):
    reps, _ = S.collapse(doc_items(spark, sf_dir, SQL_WORDS))
    return S.similar_pairs(reps).select("rep_a", "rep_b", F.round("score", 6).alias("score"))


@query("similar_document_pairs_all", "E4 E5", "WITH " + ITEMS_ALL + " SELECT rep_a, rep_b, round(score, 6) AS score FROM pairs")
def similar_document_pairs_all(spark, sf_dir):
    reps, _ = S.collapse(doc_items(spark, sf_dir))
    return S.similar_pairs(reps).select("rep_a", "rep_b", F.round("score", 6).alias("score"))


@query("document_clusters_all", "E6 E7", "WITH " + ITEMS_ALL + ", " + COMPONENTS +
       " SELECT cluster, size, edges, round(similarity, 6) AS similarity FROM clusters")
def document_clusters_all(spark, sf_dir):
    _, _, rows = doc_clusters(spark, sf_dir)
    return rows.select("cluster", "size", "edges", F.round("similarity", 6).alias("similarity"))


@query("cluster_members_all", "E6", "WITH " + ITEMS_ALL + ", " + COMPONENTS + " SELECT id, cluster FROM placed")
def cluster_members_all(spark, sf_dir):
    return S.memberships(*S.collapse(doc_items(spark, sf_dir))).select("id", "cluster")


def doc_clusters(spark, sf_dir, min_words: int | None = None):
    items = doc_items(spark, sf_dir, min_words)
    reps, members = S.collapse(items)
    pairs = S.stored(S.similar_pairs(reps))
    placed, rows = S.clusters(reps, members, pairs)
    return items, placed, rows


@query("document_clusters", "E6 E7", "WITH " + ITEMS + ", " + COMPONENTS +
       " SELECT cluster, size, edges, round(similarity, 6) AS similarity FROM clusters")
def document_clusters(spark, sf_dir):
    _, _, rows = doc_clusters(spark, sf_dir, SQL_WORDS)
    return rows.select("cluster", "size", "edges", F.round("similarity", 6).alias("similarity"))


@query("cluster_members", "E6", "WITH " + ITEMS + ", " + COMPONENTS + " SELECT id, cluster FROM placed")
def cluster_members(spark, sf_dir):
    return S.memberships(*S.collapse(doc_items(spark, sf_dir, SQL_WORDS))).select("id", "cluster")


@query("cluster_anchor_pairs", "E11", "WITH " + ITEMS + ", " + COMPONENTS + """
 SELECT p.cluster, p.cluster AS anchor, p.id AS other, round(len(list_intersect(a.sh, o.sh)) / (len(a.sh) + len(o.sh)
 - len(list_intersect(a.sh, o.sh))), 6) AS similarity FROM placed p JOIN items a ON a.id = p.cluster JOIN items o ON o.id = p.id
 WHERE p.id <> p.cluster""")
def cluster_anchor_pairs(spark, sf_dir):
    items, placed, rows = doc_clusters(spark, sf_dir, SQL_WORDS)
    anchors = rows.select("cluster", F.col("cluster").alias("anchor"))
    return S.anchor_pairs(items, placed, anchors).withColumn("similarity", F.round("similarity", 6))


@query("identical_files", "E12", ctes(DOCS) + """SELECT sha256, repo_id, path, copies FROM (SELECT *, count(*) OVER (PARTITION BY sha256)
 AS copies FROM docs WHERE size >= 200) WHERE copies > 1""")
def identical_files(spark, sf_dir):
    # counts come from a map-side aggregate and are joined back: a hot hash is never collected
    d = inputs.docs(spark, sf_dir).where("size >= 200").select("sha256", "repo_id", "path")
    copies = d.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    return d.join(copies, "sha256").select("sha256", "repo_id", "path", "copies")


@query("identical_file_groups", "E12", ctes(DOCS) + """SELECT sha256, count(*) AS copies, min(path) AS first_path, 'low' AS severity,
 concat('Identical file duplicated in ', count(*), ' places') AS title FROM docs WHERE size >= 200 GROUP BY 1 HAVING count(*) > 1""")
def identical_file_groups(spark, sf_dir):
    d = inputs.docs(spark, sf_dir).where("size >= 200")
    g = d.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")
    return g.select("sha256", "copies", "first_path", F.lit("low").alias("severity"),
                    F.format_string("Identical file duplicated in %d places", "copies").alias("title"))


@query("cluster_findings", "E13", "WITH " + ITEMS + ", " + COMPONENTS + """
 SELECT cluster, CASE WHEN size >= 3 THEN 'medium' ELSE 'low' END AS severity,
 round(least(0.97, 0.55 + similarity * 0.4), 6) AS confidence FROM clusters""")
def cluster_findings(spark, sf_dir):
    _, _, rows = doc_clusters(spark, sf_dir, SQL_WORDS)
    return rows.select("cluster", F.when(F.col("size") >= 3, "medium").otherwise("low").alias("severity"),
                       F.round(F.least(F.lit(0.97), 0.55 + F.col("similarity") * 0.4), 6).alias("confidence"))


@query("duplicate_metrics", "E14", "WITH " + ITEMS + ", " + COMPONENTS + """
 SELECT (SELECT count(*) FROM clusters) AS clusters, count(*) AS compared, (count(*) * (count(*) - 1) / 2)::BIGINT AS comparisons,
 (SELECT count(*) FROM placed) AS members FROM items""")
def duplicate_metrics(spark, sf_dir):
    items, placed, rows = doc_clusters(spark, sf_dir, SQL_WORDS)
    tagged = None
    for name, df in (("clusters", rows), ("compared", items), ("members", placed)):
        part = df.select(F.lit(name).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
        tagged = part if tagged is None else tagged.unionByName(part)
    total = tagged.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k)
                         for k in ("clusters", "compared", "members")])
    return total.select("clusters", "compared", (F.col("compared") * (F.col("compared") - 1) / 2).cast("long").alias("comparisons"),
                        "members")


# ---- functions of the code corpus ----
from sourcegrain.operators import clones as FC  # noqa: E402
from sourcegrain.operators import facts as C  # noqa: E402
from sourcegrain.plans.facts import JS_EXPORTS, SYMBOL_BASE  # noqa: E402
from sourcegrain.plans.rules import q  # noqa: E402


def _list(words):
    return "(" + ", ".join(q(w) for w in words) + ")"


# clones are sought within one repository here, so the id of the repository leads every shingle
FUNCTIONS = f"""fb AS (SELECT s.repo_id, s.path, s.name, s.line_start, s.line_end, c.language, array_to_string(c.lines[s.line_start:s.line_end], chr(10)) AS body FROM symbols s
  JOIN code c USING (repo_id, path) WHERE s.kind IN ('function', 'method') AND s.line_end - s.line_start + 1 >= 4 AND c.path NOT LIKE 'tests/%'),
 ft AS (SELECT *, list_filter(regexp_extract_all(CASE WHEN language = 'python' THEN regexp_replace(body, '#[^\\n]*', '', 'g') ELSE body END, {q(FC.TOKEN)}),
  lambda t: NOT regexp_matches(t, '^(//|/\\*)')) AS raw FROM fb),
 fn AS (SELECT *, list_transform(raw, lambda t, i: CASE WHEN regexp_matches(t, '^["''`]') THEN 'S' WHEN regexp_matches(t, '^[0-9]') THEN 'N'
  WHEN regexp_matches(t, '^[A-Za-z_$]') THEN CASE WHEN t IN {_list(FC.KEYWORDS + FC.KEEP_GLOBALS)} OR (i > 1 AND raw[i - 1] = '.') THEN t ELSE 'I' END ELSE t END) AS w FROM ft),
 fs AS (SELECT *, concat(repo_id, ':', path, ':', lpad(line_start::VARCHAR, 8, '0')) AS id FROM fn WHERE len(w) >= 25),
 items AS (SELECT id, repo_id, path, name, line_start, raw, w, len(w) AS n_tokens, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM fs)"""
_GROUPS = "keyed AS" + ITEMS.split("keyed AS", 1)[1]
CODE_ITEMS = SYMBOL_BASE + ", " + FUNCTIONS
CODE_CLUSTERS = CODE_ITEMS + ", " + _GROUPS + ", " + COMPONENTS


def function_samples(spark, sf_dir):
    return FC.samples(C.parse(inputs.code(spark, sf_dir), "symbols", "exports"))


@query("function_tokens", "E1 E2", CODE_ITEMS + " SELECT id, name, n_tokens::BIGINT AS n_tokens, len(sh) AS n_shingles, md5(array_to_string(list_sort(sh), '|')) AS shingle_md5 FROM items")
def function_tokens(spark, sf_dir):
    return function_samples(spark, sf_dir).select("id", "name", F.col("n_tokens"), F.size("shingles").alias("n_shingles"),
                                                  F.md5(F.array_join(F.array_sort("shingles"), "|")).alias("shingle_md5"))


def code_clusters(spark, sf_dir):
    items = S.stored(function_samples(spark, sf_dir))
    placed, rows = FC.function_clusters(items)
    return items, S.stored(placed), rows


@query("function_clusters", "E4 E5 E6 E7", CODE_CLUSTERS + " SELECT cluster, size, edges, round(similarity, 6) AS similarity FROM clusters")
def function_clusters(spark, sf_dir):
    return code_clusters(spark, sf_dir)[2].select("cluster", "size", "edges", F.round("similarity", 6).alias("similarity"))


_WORDS = (r"list_distinct(list_transform(regexp_extract_all(regexp_replace(replace(name, '_', ' '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), "
          r"'[A-Z]?[a-z]+|[A-Z]+|\d+'), lambda p: lower(p)))")


_TITLES = CODE_CLUSTERS + f""", mw AS (SELECT p.cluster, p.id, {_WORDS} AS words FROM placed p JOIN items i ON i.id = p.id),
 fl AS (SELECT cluster, count(*) AS size, bool_and(list_has_any(words, {list(FC.VALIDATION_WORDS)})) AS v, bool_and(list_has_any(words, {list(FC.REQUEST_WORDS)})) AS r,
  bool_or(list_has_any(words, {list(FC.SENSITIVE_WORDS)})) AS sensitive FROM mw GROUP BY 1),
 wc AS (SELECT cluster, w, count(*) AS n FROM (SELECT cluster, unnest(words) AS w FROM mw) GROUP BY 1, 2),
 nn AS (SELECT wc.cluster, min(w) AS noun FROM wc JOIN fl USING (cluster) WHERE n = size AND w NOT IN {_list(FC.NAME_STOPWORDS)} AND length(w) > 2 GROUP BY 1),
 pp AS (SELECT fl.*, noun, CASE WHEN v THEN 'validation' WHEN r THEN 'request helper' ELSE 'logic' END AS purpose FROM fl LEFT JOIN nn USING (cluster)),
 tt AS (SELECT cluster, purpose, sensitive, concat(CASE WHEN noun IS NOT NULL THEN concat(upper(noun[1]), substr(noun, 2), ' ', purpose)
  WHEN purpose = 'request helper' THEN 'API request helper' ELSE concat('Similar ', purpose) END, ' duplicated in ', size, ' places') AS title FROM pp)"""


@query("cluster_titles", "E8", _TITLES + " SELECT cluster, purpose, sensitive, title FROM tt")
def cluster_titles(spark, sf_dir):
    items, placed, _ = code_clusters(spark, sf_dir)
    return FC.describe(placed, items).select("cluster", "purpose", "sensitive", "title")


@query("function_findings", "E13", _TITLES + """ SELECT cluster, title, CASE WHEN size >= 3 OR sensitive THEN 'medium' ELSE 'low' END AS severity, sensitive,
 round(least(0.97, 0.55 + similarity * 0.4), 6) AS confidence, i.path, i.name AS symbol, i.line_start, size AS copies
 FROM tt JOIN clusters USING (cluster) JOIN items i ON i.id = cluster""")
def function_findings(spark, sf_dir):
    items, placed, rows = code_clusters(spark, sf_dir)
    return FC.cluster_findings(placed, rows, items).withColumn("confidence", F.round("confidence", 6))


_CANONICAL = CODE_CLUSTERS + ", " + JS_EXPORTS + """, cc AS (SELECT cluster, id, exported FROM (SELECT p.cluster, p.id, e.name IS NOT NULL AS exported,
 row_number() OVER (PARTITION BY cluster ORDER BY e.name IS NULL, i.path, p.id) AS rn FROM placed p JOIN items i ON i.id = p.id
 LEFT JOIN exported e ON e.repo_id = i.repo_id AND e.path = i.path AND e.name = i.name WHERE i.path LIKE 'utils/%' OR i.path LIKE 'lib/%') WHERE rn = 1)"""


@query("function_duplicate_metrics", "E14", _CANONICAL + """ SELECT (SELECT count(*) FROM clusters) AS clusters, count(*) AS compared,
 (count(*) * (count(*) - 1) // 2)::BIGINT AS comparisons, (SELECT count(*) FROM cc) AS reuse_existing FROM items""")
def function_duplicate_metrics(spark, sf_dir):
    items, placed, rows = code_clusters(spark, sf_dir)
    return FC.duplicate_metrics(placed, rows, items)


@query("canonical_copies", "E9", _CANONICAL + " SELECT cluster, id, exported FROM cc")
def canonical_copies(spark, sf_dir):
    items, placed, _ = code_clusters(spark, sf_dir)
    return FC.canonical(placed, items).select("cluster", "id", "exported")


@query("cluster_shared_literals", "E10", CODE_CLUSTERS + f""", li AS (SELECT p.cluster, p.id, unnest(list_distinct(list_filter(raw, lambda t: regexp_matches(t, '^["''`]') AND length(t) > 4))) AS lit
  FROM placed p JOIN items i ON i.id = p.id), lc AS (SELECT cluster, lit, count(*) AS n FROM li GROUP BY 1, 2),
 sz AS (SELECT cluster, count(*) AS size FROM placed GROUP BY 1),
 lr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY -length(lit), lit) AS rn FROM lc JOIN sz USING (cluster)
  WHERE n = size AND trim(lit, '''"`') NOT IN {_list(FC.TRIVIAL_LITERALS)})
 SELECT cluster, string_agg(left(lit, 80), ',' ORDER BY rn) AS literals FROM lr WHERE rn <= 3 GROUP BY 1""")
def cluster_shared_literals(spark, sf_dir):
    items, placed, _ = code_clusters(spark, sf_dir)
    return FC.shared_literals(placed, items).select("cluster", F.array_join("literals", ",").alias("literals"))
