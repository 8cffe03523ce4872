"""Report storyline: cited sections per repository and their time allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.operators import facts as C
from sourcegrain.operators.findings import severity_rank
from sourcegrain.operators.graph import AUTH_NAME, readme_intro

# Sections, their base seconds, the target and the grain of a duration.
BASE_SECONDS = {"overview": 15, "architecture": 15, "flow": 20, "auth": 15, "security": 20, "duplicates": 15, "history": 10, "next": 10}
TARGET_SECONDS = 120
GRAIN = 5


def _top(df: DataFrame, order: list, limit: int) -> DataFrame:
    w = Window.partitionBy("repo_id").orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def storyline(parsed: DataFrame, layers: DataFrame, evidence: DataFrame, claims: DataFrame, flows: DataFrame, notes: DataFrame,
              clusters: DataFrame | None = None) -> DataFrame:
    """Citations of every section: repo_id, section, section_no, n, path, line, label.

    ``clusters`` holds the members of the first clone cluster: repo_id, path, line, label, n.
    """
    def section(df: DataFrame, key: str) -> DataFrame:
        no = list(BASE_SECONDS).index(key) + 1
        return df.select("repo_id", F.lit(key).alias("section"), F.lit(no).alias("section_no"), F.col("n").cast("int").alias("n"), "path",
                         F.col("line").cast("int").alias("line"), "label")
    overview = readme_intro(parsed).select("repo_id", F.lit(1).alias("n"), "path", F.lit(1).alias("line"), F.lit("Project intro").alias("label"))
    arch = evidence.where("n = 1").drop("n").join(layers.select("repo_id", "layer", "layer_no"), ["repo_id", "layer"])
    arch = _top(arch.withColumn("label", F.concat_ws(": ", "layer", "label")), ["layer_no"], 4)
    flow = flows.where("flow_no = 1 AND step_no <= 6").select("repo_id", F.col("step_no").alias("n"), F.col("step_path").alias("path"), F.col("step_line").alias("line"),
                                                              F.concat_ws(": ", "layer", "label").alias("label"))
    auth = C.table(parsed, "symbols").where(F.col("name").rlike(AUTH_NAME) & (F.col("kind") != "class"))
    auth = _top(auth.withColumn("line", F.col("line_start")).withColumn("label", F.concat("name", F.lit("()"))),
                [~F.lower("name").rlike("^(require|verify|auth)"), F.col("path"), F.col("ordinal")], 3)
    ranked = _top(claims.withColumn("label", F.col("title")), [severity_rank(F.col("severity")), -F.col("confidence"), F.col("path"), F.col("line"), F.col("rule_id")], 3)
    told = notes.where("ordinal <= 3").withColumn("n", F.col("ordinal")).withColumn("label", F.lit("history"))
    parts = [section(overview, "overview"), section(arch, "architecture"), section(flow, "flow"), section(auth, "auth"), section(ranked, "security"),
             section(told, "history"), section(ranked.where("n <= 2").withColumn("label", F.concat(F.lit("Fix: "), "title")), "next")]
    if clusters is not None:
        parts.append(section(clusters.where("n <= 5"), "duplicates"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def fit_durations(steps: DataFrame) -> DataFrame:
    """Scale durations of a repository's steps (repo_id, pos, duration) to the target.

    Only when there are five or more steps or the target is passed: multiples of the grain, at least
    one grain each, rounding drift added to the first longest step. A storyline has eight steps at most.
    """
    w = Window.partitionBy("repo_id")
    df = steps.withColumn("_total", F.sum("duration").over(w)).withColumn("_scaled", (F.count("*").over(w) >= 5) | (F.col("_total") > TARGET_SECONDS))
    fitted = F.greatest(F.lit(GRAIN), (F.bround(F.col("duration") * TARGET_SECONDS / F.col("_total") / GRAIN) * GRAIN).cast("long"))
    df = df.withColumn("duration", F.when(F.col("_scaled"), fitted).otherwise(F.col("duration")))
    df = df.withColumn("_drift", TARGET_SECONDS - F.sum("duration").over(w)).withColumn("_longest", F.row_number().over(w.orderBy(F.desc("duration"), "pos")))
    moved = F.greatest(F.lit(GRAIN), F.col("duration") + F.col("_drift"))
    return df.withColumn("duration", F.when(F.col("_scaled") & (F.col("_longest") == 1), moved).otherwise(F.col("duration"))).drop(
        "_total", "_scaled", "_drift", "_longest")
