"""Intent of questions and topics of tasks by keyword, as column expressions over text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: keyword lists in order of precedence ----
QUESTION_INTENTS = {
    "security": ["security", "vulnerab", "secret", "injection", "risk", "unsafe", "attack", "leak", "api key", "issue", "finding"],
    "duplicate": ["duplicate", "duplicat", "redundan", "copy", "copies", "repeated", "reuse", "already implemented", "already exist"],
    "history": ["history", "legacy", "deprecated", "old ", "previous", "before", "replaced", "changed"],
    "architecture": ["architecture", "stack", "structure", "overview", "how does", "what does", "flow", "built"],
    "location": ["where", "which file", "located", "find ", "defined"],
}
TASK_TOPICS = {
    "security": ["security", "secure", "vulnerab", "secret", "injection", "xss", "cors", "jwt", "audit", "risk", "credential", "exploit"],
    "duplicate": ["duplicate", "duplicat", "redundan", "copy", "copies", "clone", "dry", "repeated", "similar"],
    "explainer": ["architecture", "explain", "understand", "overview", "structure", "how does", "what does", "summary", "summar", "map "],
    "walkthrough": ["walkthrough", "walk through", "presentation", "present", "demo", "tour", "onboard", "pitch", "judge"],
}
FULL_WORDS = ["full analysis", "everything", "analyze this repository", "analyse this repository", "all agents"]
DEPENDENCIES = {"walkthrough": ["explainer", "security", "duplicate"]}
SCANNER_KEYWORDS = {
    "secrets": ["secret", "api key", "apikey", "credential", "password", "hardcoded", "private key"],
    "injection": ["injection", "sql", "xss", "eval", "command", "traversal", "sanitiz", "mass assignment", "input validation"],
    "auth": ["jwt", "auth", "token", "session", "crypto", "hash", "random", "signature"],
    "exposure": ["cors", "tls", "https", "plain http", "debug", "misconfig", "configuration", "exposure", "exposed", "environment variable",
                 "env var", "certificate"],
    "prompt": ["prompt", "ai safety", "planted instruction"],
}
# ---- end of fixed values ----


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def first_keyword(text: Column, words: list[str]) -> Column:
    """The first listed keyword that occurs in the text, null for none."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def question_intent(question: Column) -> Column:
    low = padded(question)
    return F.coalesce(*[F.when(first_keyword(low, words).isNotNull(), F.lit(intent)) for intent, words in QUESTION_INTENTS.items()], F.lit("general"))


def route_topics(tasks: DataFrame, text: str, table: dict[str, list[str]], dependencies: dict[str, list[str]] | None = None,
                 full_words: list[str] | None = None) -> DataFrame:
    """One row per task and topic: selected or skipped, with the reason.

    No match at all, or a word asking for everything, selects every topic. Dependencies of a selected
    topic are selected too.
    """
    low = padded(F.col(text))
    rows = tasks.withColumn("_hits", F.create_map(*[x for t, words in table.items() for x in (F.lit(t), first_keyword(low, words))]))
    full = F.exists(F.array(*[F.lit(w) for w in full_words]), lambda w: F.contains(low, w)) if full_words else F.lit(False)
    rows = rows.withColumn("_none", ~F.exists(F.map_values("_hits"), lambda v: v.isNotNull())).withColumn("_full", full)
    rows = rows.select("*", F.explode(F.array(*[F.lit(t) for t in table])).alias("topic"))
    hit = F.element_at("_hits", F.col("topic"))
    needed = F.coalesce(*[F.when(F.col("topic").isin(deps) & F.element_at("_hits", F.lit(name)).isNotNull(), F.lit(f"Required by {name}"))
                          for name, deps in (dependencies or {}).items()], F.lit(None).cast("string"))
    reason = (F.when(hit.isNotNull(), F.concat(F.lit("Task mentions '"), F.trim(hit), F.lit("'")))
              .when(F.col("_none"), "No specific focus detected: full analysis").when(F.col("_full"), "Full analysis requested")
              .when(needed.isNotNull(), needed).otherwise("Not required for this task"))
    selected = hit.isNotNull() | F.col("_none") | F.col("_full") | needed.isNotNull()
    return rows.withColumn("selected", selected).withColumn("reason", reason).drop("_hits", "_none", "_full")
