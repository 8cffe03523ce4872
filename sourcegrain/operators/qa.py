"""Extractive answers: key lines, identifier occurrences, names, findings summary, answer rows.

``hits`` holds query_id, rank, path, passage_id, memory_type, symbol, line_start, line_end, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import redact as rd
from sourcegrain.functions import text as tx
from sourcegrain.functions.identifiers import split_identifier
from sourcegrain.functions.stages import hold
from sourcegrain.operators.findings import severity_rank
from sourcegrain.operators.search import all_terms
from sourcegrain.session import shuffled

# Line and name patterns.
INTERESTING = r"[(=]|\bfunction\b|\bdef\b|\bclass\b|=>"
IMPORTING = r"\b(require|import)\b|module\.exports|^\s*export\s*\{"
DEFINING = r"^\s*(?:export\s+)?(?:async\s+)?(?:function|def|class)\b|\b(?:app|router)\.(?:get|post|put|patch|delete)\("
FUNCTION_NAME = r"(?:function\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(|def\s+(\w+))"
ROUTE = r"""\b(?:app|router)\.(get|post|put|patch|delete)\(\s*['"`]([^'"`]+)"""


def _lines(hits: DataFrame) -> DataFrame:
    return hits.select("*", F.posexplode(F.split("content", "\n", -1)).alias("offset", "s")).withColumn("line", F.col("line_start") + F.col("offset"))


def key_lines(hits: DataFrame, plans: DataFrame, limit: int = 3) -> DataFrame:
    """The best lines of the first four hits: matched terms, identifiers, definitions and assignments."""
    rows = _lines(hits.where("rank <= 4 AND memory_type IN ('symbol', 'code')").select("query_id", "rank", "path", "line_start", "content"))
    rows = rows.drop("content").join(shuffled(plans.select("query_id", "terms", "expanded", "identifiers")), "query_id")
    s = F.col("s")
    rows = rows.where(s.rlike(r"\S") & ~tx.strip(s).rlike(r"^(//|#|\*)") & s.rlike(INTERESTING))
    rows = hold(rows, low=F.lower("s"), ids=F.filter("identifiers", lambda i: F.contains("s", i)))
    rows = hold(rows, matched=F.filter(all_terms(), lambda t: (F.length(t) > 2) & F.col("low").contains(t)))
    rows = rows.where((F.size("identifiers") == 0) | (F.size("ids") > 0)).where((F.size("matched") > 0) | (F.size("ids") > 0))
    primary = F.size(F.array_intersect("matched", "terms"))
    assigned = F.exists("ids", lambda i: F.rlike(F.col("s"), F.concat(F.lit("\\b\\Q"), i, F.lit("\\E\\s*=(?!=)"))))
    score = (F.size("matched") + primary - (F.col("rank") - 1) * 0.3 + 4 * F.size("ids") - F.when(s.rlike(IMPORTING), 1.5).otherwise(0.0)
             + F.when(s.rlike(DEFINING), 0.5).otherwise(0.0) + F.when(assigned, 2.0).otherwise(0.0))
    best = rows.withColumn("score", score).groupBy("query_id", "path", "line").agg(F.max("score").alias("score"), F.first("s").alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "path", "line")
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select(
        "query_id", "n", "path", "line", "score", tx.ellipsis(rd.redact(tx.strip(s)), 140, 139).alias("text"))


def identifier_occurrences(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """Distinct lines of each file of the hits that hold the first identifier of the query."""
    first = plans.select("query_id", F.try_element_at("identifiers", F.lit(1)).alias("identifier")).where("identifier IS NOT NULL")
    rows = _lines(hits.select("query_id", "path", "line_start", "content")).join(shuffled(first), "query_id").where(F.contains("s", "identifier"))
    return rows.select("query_id", "identifier", "path", "line").distinct()


def relevance(name: Column) -> Column:
    """Two per primary term and one per expanded term that shares a prefix with a part of the name."""
    parts = split_identifier(name)

    def fits(t: Column) -> Column:
        head = F.substring(t, 1, 4)
        return (F.length(t) >= 3) & F.exists(parts, lambda p: p.startswith(head) | ((F.length(p) >= 3) & t.startswith(p)))
    return 2 * F.size(F.filter("terms", fits)) + F.size(F.filter(F.array_except("expanded", "terms"), fits))


def names_in_hits(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """Function and route names of each hit with their relevance; a symbol hit has its own name."""
    groups = [F.regexp_extract_all("content", F.lit(FUNCTION_NAME), F.lit(g)) for g in (1, 2, 3)]
    functions = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b))
    routes = F.zip_with(F.regexp_extract_all("content", F.lit(ROUTE), F.lit(1)), F.regexp_extract_all("content", F.lit(ROUTE), F.lit(2)),
                        lambda m, p: F.concat_ws(" ", F.upper(m), p))
    own = F.col("symbol").isNotNull() & (F.col("memory_type") == "symbol")
    rows = hold(hits.select("query_id", "rank", "path", "passage_id", "symbol", "memory_type", "content"),
                names=F.array_distinct(F.when(own, F.array("symbol")).otherwise(F.concat(functions, routes))))
    rows = rows.select("query_id", "rank", "path", "passage_id", F.posexplode("names").alias("ordinal", "name"))
    return rows.join(shuffled(plans.select("query_id", "terms", "expanded")), "query_id").withColumn("relevance", relevance(F.col("name"))).drop("terms", "expanded")


def answer_rows(hits: DataFrame, names: DataFrame, max_paths: int = 3) -> DataFrame:
    """Up to three files per query with their first ranges and most relevant names."""
    by_path = hits.groupBy("query_id", "path").agg(F.min("rank").alias("first_rank"), F.slice(F.array_sort(F.collect_list(F.struct(
        "rank", F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")).alias("span")))), 1, 2).alias("spans"))
    w = Window.partitionBy("query_id").orderBy("first_rank", "path")
    by_path = by_path.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_paths)
    one = names.groupBy("query_id", "path", "name").agg(F.min(F.struct("rank", "ordinal")).alias("pos"), F.max("relevance").alias("r"))
    picked = one.groupBy("query_id", "path").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("neg"), "pos", "name"))), 1, 3).alias("ns"))
    label = F.array_join(F.transform("ns", lambda x: x["name"]), ", ")
    return by_path.join(shuffled(picked), ["query_id", "path"], "left").select("query_id", "n", "path", F.array_join(F.transform("spans", lambda x: x["span"]), ", ").alias("ranges"),
                                                                     F.coalesce(label, F.lit("relevant passage")).alias("names"))


def findings_summary(findings: DataFrame, top: int = 6) -> DataFrame:
    """First findings per repository with the severity breakdown of all of them."""
    order = ["critical", "high", "medium", "low", "info"]
    counts = findings.groupBy("repo_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in order])
    text = F.array_join(F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in order])), ", ")
    w = Window.partitionBy("repo_id").orderBy(severity_rank(F.col("severity")), "path", "line", "title")
    first = findings.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select("repo_id", "n", "severity", "title", "path", "line")
    return first.join(counts.select("repo_id", "total", text.alias("breakdown")), "repo_id")


def first_sentence(text: Column, limit: int = 220) -> Column:
    return tx.ellipsis(F.element_at(F.split(tx.strip(text), r"(?<=[.!?])\s", 2), 1), limit, limit - 1)
