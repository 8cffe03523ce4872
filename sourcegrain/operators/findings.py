"""From claims to findings: filtering, merging, fingerprints, order and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.ranking import number_rows
from sourcegrain.operators.verify import REJECTED, anchor
from sourcegrain.session import stored

# Severity order.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, severity), F.lit(9))


def filter_claims(claims: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) claims after anchoring; accepted ones carry their corrected lines.

    The anchored claims are stored, since both parts and all that follows read them.
    """
    anchored = stored(anchor(claims, files))
    bad = F.col("status").isin(list(REJECTED))
    return anchored.where(~bad), anchored.where(bad)


def filter_locations(claims: DataFrame, locations: DataFrame, files: DataFrame, keep_counts: bool = False) -> DataFrame:
    """Claims whose located copies still hold: a claim with locations needs two verified ones (``kept``, on request)."""
    good = anchor(locations, files).where(~F.col("status").isin(list(REJECTED)))
    kept = good.groupBy("claim_id").agg(F.count("*").alias("kept"))
    had = locations.groupBy("claim_id").agg(F.count("*").alias("had"))
    return (claims.join(had, "claim_id", "left").join(kept, "claim_id", "left")
            .where(F.col("had").isNull() | (F.coalesce("kept", F.lit(0)) >= 2)).drop("had", *([] if keep_counts else ["kept"])))


def merge_claims(claims: DataFrame) -> DataFrame:
    """Merge claims on the same spot (repo_id, category, path, line) with compatible families.

    Claims join the first cluster whose first family equals theirs or is null, or when theirs is
    null. Written as keys: with ``f`` the family of the first claim of the spot, everything is one
    cluster when ``f`` is null, otherwise a claim belongs to cluster ``coalesce(family, f)``.
    Needs claim_order (arrival order), detector, severity, source, confidence, title.
    """
    spot = ["repo_id", "category", "path", "line"]
    first = claims.groupBy(*spot).agg(F.min_by(F.struct("family"), "claim_order").alias("_f"))
    keyed = claims.join(first, spot).withColumn("cluster", F.when(F.col("_f.family").isNull(), F.lit("*")).otherwise(
        F.coalesce("family", F.col("_f.family")))).drop("_f")
    rank = F.struct(severity_rank(F.col("severity")), F.col("source") != "rule", -F.col("confidence"), F.col("claim_order"))
    head = F.struct("title", "severity", "family", "source", "rule_id", "evidence", "confidence", "line_end")
    # per detector first, so the collected list is as short as the list of detectors
    per_detector = keyed.groupBy(*spot, "cluster", "detector").agg(
        F.min(rank).alias("r"), F.min_by(head, rank).alias("head"), F.max("confidence").alias("top"), F.count("*").alias("n"),
        F.collect_set("severity").alias("sev"))
    merged = per_detector.groupBy(*spot, "cluster").agg(
        F.min_by("head", "r").alias("h"), F.max("top").alias("_top"), F.sum("n").alias("merged_from"),
        F.array_sort(F.collect_list(F.struct("r", "detector"))).alias("_d"),
        F.array_distinct(F.flatten(F.collect_list("sev"))).alias("_sev"))
    confidence = F.when(F.col("merged_from") == 1, F.col("h.confidence")).otherwise(
        F.least(F.lit(0.99), F.col("_top") + 0.04 * (F.col("merged_from") - 1)))
    return merged.select(*spot, "h.title", "h.severity", "h.family", "h.source", "h.rule_id", "h.evidence", "h.line_end",
                         confidence.alias("confidence"), "merged_from",
                         F.transform("_d", lambda d: d["detector"]).alias("detectors"),
                         F.size("_sev").alias("severities"))


def conflicts(merged: DataFrame) -> DataFrame:
    return merged.where("severities > 1")


def result_order() -> list[Column]:
    return [(F.col("category") != "security").asc(), severity_rank(F.col("severity")).asc(), F.col("path").asc(),
            F.col("line").asc()]


def fingerprint(category: Column, rule_or_title: Column, path: Column, anchor_text: Column) -> Column:
    rule = F.regexp_replace(F.lower(rule_or_title), r"\d+", "N")
    text = F.lower(tx.squash(anchor_text))
    return F.substring(F.sha2(F.concat_ws("|", category, rule, path, text), 256), 1, 16)


def duplicate_anchor(members: Column) -> Column:
    """Anchor text of a clone finding: its members (path, symbol) in order."""
    names = F.transform(members, lambda m: F.concat(m["path"], F.lit("#"), F.coalesce(m["symbol"], F.lit("None"))))
    return F.array_join(F.array_sort(names), ",")


def with_identity(findings: DataFrame) -> DataFrame:
    """Add fingerprint, 0-based position in result order per repository, and the finding id."""
    marked = findings.withColumn("fingerprint", fingerprint(
        F.col("category"), F.coalesce("rule_id", "title"), F.col("path"), F.coalesce("evidence", F.lit(""))))
    placed = number_rows(marked, [*result_order(), F.col("fingerprint").asc()], "position", per="repo_id", start=0)
    raw = F.concat_ws("|", "repo_id", "fingerprint", "path", F.col("line").cast("string"), F.col("position").cast("string"))
    return placed.withColumn("finding_id", F.substring(F.sha2(raw, 256), 1, 16))


def number_findings(findings: DataFrame, with_category: bool = True) -> DataFrame:
    """Numbers used to name findings: severity, category, path, line."""
    order = [severity_rank(F.col("severity")).asc()] + ([F.col("category").asc()] if with_category else []) + [
        F.col("path").asc(), F.col("line").asc(), F.col("finding_id").asc()]
    return number_rows(findings, order, "number", per="repo_id")


def from_hits(hits: DataFrame) -> DataFrame:
    """Findings of rule hits (repo_id, path, line_no, text, sha256 and the columns of a scan): one per hit, with its
    fingerprint and the hash of its line, so that no content has to be fetched to cite it."""
    rows = hits.select("repo_id", F.lit("security").alias("category"), "path", F.col("line_no").alias("line"), "rule_id", "rule_order", "title",
                       "severity", "confidence", "evidence", F.sha2(tx.rstrip(F.col("text")), 256).alias("evidence_sha256"),
                       F.col("sha256").alias("file_sha256"))
    return rows.withColumn("fingerprint", fingerprint(F.col("category"), F.col("rule_id"), F.col("path"), F.col("evidence")))


def number_occurrences(findings: DataFrame) -> DataFrame:
    """Add ``occurrence``: the place, from 1, of a finding among those of its fingerprint, in line order.

    The window's keys hold the path, so a group is never larger than the findings of one file.
    """
    w = Window.partitionBy("repo_id", "path", "fingerprint").orderBy("line", "rule_order")
    return findings.withColumn("occurrence", F.row_number().over(w))


def _states(old: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Outer join of both sides on ``key`` with ``state``; old holds old_title, now holds title."""
    had = old.select("repo_id").distinct().withColumn("_had", F.lit(True))
    both = old.join(now, key, "full_outer").join(had, "repo_id", "left")
    state = (F.when(F.col("title").isNull(), "resolved").when(F.col("_had").isNull(), "first")
             .when(F.col("old_title").isNull(), "new").otherwise("unchanged"))
    return both.withColumn("state", state).withColumn("title", F.coalesce("title", "old_title")).drop("_had", "old_title")


def lifecycle(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Each fingerprint of two analyses as resolved, new or unchanged; first analyses have no new ones.

    Every current finding is a row; equal earlier ones count once, under their last title by analysis_order.
    """
    old = previous.groupBy("repo_id", "fingerprint").agg(F.max_by("title", "analysis_order").alias("old_title"))
    states = _states(old, current.select("repo_id", "fingerprint", "title"), ["repo_id", "fingerprint"])
    return states.select("repo_id", "fingerprint", "title", "state")


def occurrence_lifecycle(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Findings of two analyses matched one to one: the n-th of a fingerprint with the n-th, in line order.

    A file that holds a finding twice and later once has one unchanged and one resolved row; ``old_line`` and ``line``
    tell where each side stands, one of them null where that side has no such finding.
    """
    key = ["repo_id", "path", "fingerprint", "occurrence"]
    old = number_occurrences(previous).select(*key, F.col("title").alias("old_title"), F.col("line").alias("old_line"))
    now = number_occurrences(current).select(*key, "title", "line")
    return _states(old, now, key).select(*key, "title", "old_line", "line", "state")


def lifecycle_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("repo_id").agg(*[F.count_if(F.col("state") == s).alias(s)
                                           for s in ("resolved", "new", "unchanged", "first")])


def check_counters(claims: DataFrame, accepted: DataFrame, rejected: DataFrame, merged: DataFrame) -> DataFrame:
    """Cross-validation counters per repository in long form."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("repo_id").agg(F.count("*").alias("value")).withColumn("check", F.lit(name))
    parts = [counted(claims, "claims"), counted(accepted, "evidence at the cited line"),
             counted(merged.where("merged_from > 1"), "duplicate detections merged"),
             counted(conflicts(merged), "severity conflicts resolved"), counted(rejected, "unsupported claims rejected"),
             counted(accepted.where("relocated_from IS NOT NULL"), "citations corrected")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("repo_id", "check", "value")


def annotate_legacy(findings: DataFrame, symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """Security findings inside a symbol that a legacy note names: (repo_id, path, line, note)."""
    from sourcegrain.operators.facts import innermost_symbol
    spots = findings.where("category = 'security'").select("repo_id", "path", "line").distinct()
    inside = innermost_symbol(spots, symbols)
    by_symbol = notes.select("repo_id", F.explode("symbols").alias("name"), "note", "path", "line", "ordinal").groupBy(
        "repo_id", "name").agg(F.min_by(F.struct(F.col("path").alias("note_path"), F.col("line").alias("note_line")), "ordinal").alias("n"))
    return inside.join(by_symbol, ["repo_id", "name"]).select("repo_id", "path", "line", "name", "n.note_path", "n.note_line")


def annotate_clones(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Security findings inside a clone member: first cluster by rank. Spans meet by line buckets."""
    size = 64
    cut = members.withColumn("_b", F.explode(F.sequence(F.floor(F.col("line_start") / size).cast("int"),
                                                        F.floor(F.col("line_end") / size).cast("int"))))
    spots = findings.where("category = 'security'").select("repo_id", "path", "line").distinct().withColumn(
        "_b", F.floor(F.col("line") / size).cast("int"))
    hit = spots.join(cut, ["repo_id", "path", "_b"]).where("line BETWEEN line_start AND line_end")
    return hit.groupBy("repo_id", "path", "line").agg(
        F.min_by(F.struct("cluster", "size"), F.struct(-F.col("size"), F.col("cluster"))).alias("c")).select("repo_id", "path", "line", "c.*")


def insight_rows(findings: DataFrame, states: DataFrame) -> DataFrame:
    """Text rows that make findings and resolved findings searchable."""
    found = findings.select("repo_id", F.lit("finding").alias("memory_type"), F.concat(
        F.initcap("category"), F.lit(" finding ("), F.col("severity"), F.lit("): "), F.col("title"), F.lit(" at "), F.col("path"),
        F.lit(":"), F.col("line").cast("string"), F.lit(".")).alias("content"))
    gone = states.where("state = 'resolved'").select("repo_id", F.lit("history").alias("memory_type"), F.concat(
        F.lit("Resolved since the previous analysis: "), F.col("title"), F.lit(".")).alias("content"))
    return found.unionByName(gone)


def repository_metrics(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository: files, findings by category, verified and stale counts."""
    f = findings.groupBy("repo_id").agg(
        F.count_if(F.col("category") == "security").alias("security"),
        F.count_if(F.col("category") == "duplicate").alias("duplicate"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "stale").alias("stale"), F.count("*").alias("total"))
    n = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    return n.join(f, "repo_id", "left").fillna(0)


def verification_breakdown(findings: DataFrame) -> DataFrame:
    known = ["verified", "stale", "missing"]
    return findings.groupBy("repo_id").agg(F.count("*").alias("total"), *[
        F.count_if(F.col("status") == s).alias(s) for s in known],
        F.count_if(~F.col("status").isin(known)).alias("other"))


def visible(findings: DataFrame, category: str = "all", status: str = "all", severity: str = "all") -> DataFrame:
    """List filter; status ``stale`` means anything that is not verified."""
    if category != "all":
        findings = findings.where(F.col("category") == category)
    if status == "stale":
        findings = findings.where("status <> 'verified'")
    elif status != "all":
        findings = findings.where(F.col("status") == status)
    return findings if severity == "all" else findings.where(F.col("severity") == severity)
