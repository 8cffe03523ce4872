"""Citation verification: claims and citations against the current content.

What is asked of a file (a place, an evidence or a hash) is made distinct and gathered into one array per file, which
meets the file's lines once: no content travels to claims, lines are cleaned once per file, and a file that a third of
all claims cite is asked each question once. The answers, a few short columns, then join the claims on file and question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.stages import hold
from sourcegrain.sources.listing import unsafe_reason

# Statuses by rising severity, the redaction marker, shortest evidence that may move a claim.
STATUS_RANK = {"verified": 0, "stale": 1, "invalid_line": 2, "missing": 3, "unsupported": 4, "unsafe_path": 5}
MARKER = "[REDACTED]"
MIN_RELOCATE = 6
REJECTED = ("unsupported", "invalid_line", "missing", "unsafe_path")


def status_rank(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), status)


def worst_status(status: Column) -> Column:
    """Aggregate: the worst of many statuses; verified for none."""
    return F.coalesce(F.max_by(status, status_rank(status)), F.lit("verified"))


def evidence_parts(evidence: Column) -> Column:
    text = F.regexp_replace(tx.squash(evidence), "…$", "")
    parts = F.split(text, F.lit(r"\[REDACTED\]"), -1)
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def parts_match(parts: Column, text: Column) -> Column:
    """All parts appear in ``text`` in order."""
    def step(pos: Column, part: Column) -> Column:
        found = F.position(part, text, pos)
        return F.when(pos == 0, 0).when(found == 0, 0).otherwise(found + F.length(part))
    return F.when(F.size(parts) == 1, F.contains(text, F.get(parts, F.lit(0)))).otherwise(F.aggregate(parts, F.lit(1), step) > 0)


def evidence_matches(evidence: Column, cited: Column) -> Column:
    return F.coalesce(parts_match(evidence_parts(evidence), tx.squash(cited)), F.lit(True))


def _asked(rows: DataFrame, files: DataFrame, question: list[str]) -> DataFrame:
    """One row per file that ``rows`` cite: repo_id, path, _asked (array of distinct questions), _lines, _sha, null for a missing file."""
    asked = rows.groupBy("repo_id", "path").agg(F.collect_set(F.struct(*question)).alias("_asked"))
    current = files.select("repo_id", "path", F.col("lines").alias("_lines"), F.col("sha256").alias("_sha"))
    return asked.join(current, ["repo_id", "path"], "left")


def _answered(rows: DataFrame, asked: DataFrame, question: list[str], *answer: str) -> DataFrame:
    """``rows`` with the fields ``answer`` of their question, ``_n`` (lines of the file, null for a missing one) and ``_sha``."""
    key = ["repo_id", "path", *question]
    flat = asked.select("repo_id", "path", F.when(F.col("_lines").isNotNull(), F.size("_lines")).alias("_n"), "_sha", F.explode("_asked").alias("a"))
    flat = flat.select("repo_id", "path", *[F.col(f"a.{c}") for c in question], *[F.col(f"a.{c}").alias(f"_{c}") for c in answer], "_n", "_sha")
    flat = flat.withColumnsRenamed({c: f"_q_{c}" for c in key})
    same = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in key]
    return rows.join(flat, same, "left").drop(*[f"_q_{c}" for c in key])


def _each(df: DataFrame, **fields) -> DataFrame:
    """Add fields to every question; each is a function of the question and is worked out once."""
    def grown(a: Column) -> Column:
        for name, value in fields.items():
            a = a.withField(name, value(a))
        return a
    return hold(df, _asked=F.transform("_asked", grown))


def anchor(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Anchor claims (repo_id, path, line, line_end, evidence, indexed_sha256) in the current files.

    Adds status, corrected line and line_end, relocated_from, evidence_sha256 and file_sha256. Claims without a path, or
    of a file without text, are missing; without evidence, any line within the file will do; equal claims stay as they are.
    """
    question = ["line", "line_end", "evidence"]
    df = _asked(claims, files, question)
    n = F.size("_lines")
    df = _each(df, end=lambda a: F.greatest(F.coalesce(a["line_end"], a["line"]), a["line"]),
               parts=lambda a: F.when(F.coalesce(a["evidence"], F.lit("")) != "", evidence_parts(a["evidence"])),
               may_move=lambda a: F.length(tx.squash(F.element_at(tx.split_lines(a["evidence"]), 1))) >= MIN_RELOCATE)
    df = hold(df, _clean=F.transform("_lines", tx.squash))  # a window's squashed text is that of its lines, joined

    def window(start: Column, length: Column) -> Column:
        return F.when(length == 1, F.get("_clean", start - 1)).otherwise(
            F.array_join(F.filter(F.slice("_clean", start, length), lambda x: x != ""), " "))

    def in_range(a: Column) -> Column:
        return (a["line"] >= 1) & (a["line"] <= n)

    df = _each(df, cited=lambda a: F.coalesce(F.when(in_range(a), F.coalesce(
        parts_match(a["parts"], window(a["line"], a["end"] - a["line"] + 1)), F.lit(True))), F.lit(False)))
    # the first window that holds the evidence: once it is found, no further one is looked at
    df = _each(df, found=lambda a: F.when(
        F.col("_lines").isNotNull() & ~a["cited"] & a["parts"].isNotNull() & a["may_move"] & (n > 0),
        F.aggregate(F.sequence(F.lit(1), n), F.lit(None).cast("int"), lambda first, i: F.coalesce(
            first, F.when(parts_match(a["parts"], window(i, a["end"] - a["line"] + 1)), i)))))
    df = _each(df, last=lambda a: F.when(a["found"].isNotNull(), F.least(n, a["found"] + a["end"] - a["line"]))
               .when(in_range(a), F.least(a["end"], n)).otherwise(a["end"]))
    df = _each(df, hash=lambda a: F.when(a["cited"] | a["found"].isNotNull(), tx.hash_range(F.col("_lines"), F.coalesce(a["found"], a["line"]), a["last"])))
    df = _answered(claims, df, question, "cited", "found", "last", "hash")
    outside = ~((F.col("line") >= 1) & (F.col("line") <= F.col("_n")))
    status = (F.when(unsafe_reason(F.col("path")).isNotNull(), "unsafe_path").when(F.col("_n").isNull(), "missing")
              .when(outside & F.col("_found").isNull(), "invalid_line")
              .when(~F.col("_cited") & F.col("_found").isNull(), "unsupported")
              .when(F.coalesce("indexed_sha256", F.lit("")).isin("") | (F.col("indexed_sha256") == F.col("_sha")), "verified")
              .otherwise("stale"))
    df = df.withColumn("status", status)
    ok = F.col("status").isin("verified", "stale")
    return (df.withColumn("relocated_from", F.when(ok & F.col("_found").isNotNull(), F.col("line")))
            .withColumn("evidence_sha256", F.when(ok, F.col("_hash")).otherwise(""))
            .withColumn("line_end", F.col("_last"))
            .withColumn("line", F.coalesce("_found", "line"))
            .withColumn("file_sha256", F.coalesce("_sha", F.lit("")))
            .withColumn("message", anchor_message())
            .drop("_n", "_sha", "_cited", "_found", "_last", "_hash"))


def anchor_message() -> Column:
    s = F.col("status")
    moved = F.format_string("Citation corrected from line %d to line %d.", F.col("relocated_from"), F.col("line"))
    return (F.when(s.isin("unsafe_path", "missing"), "Cited file unavailable.")
            .when(s == "invalid_line", "The cited line is outside the file.")
            .when(s == "unsupported", "The claimed evidence does not appear in the cited source.")
            .when(s == "stale", "File changed after it was indexed. Re-run analysis.")
            .when(F.col("relocated_from").isNotNull(), moved).otherwise("Evidence confirmed at the cited lines."))


def verify(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Re-check citations (repo_id, path, line_start, line_end, evidence_sha256, file_sha256).

    Adds status, file_changed, lines_changed, relocated_line and the current hashes. Moved ranges are looked up in an
    index of window hashes: one list per file and length, made only for lengths of ranges that differ now.
    """
    question = ["line_start", "line_end", "evidence_sha256"]
    df = _asked(citations, files, question)
    n = F.size("_lines")
    df = _each(df, end=lambda a: F.greatest(F.coalesce(a["line_end"], a["line_start"]), a["line_start"]),
               expected=lambda a: F.coalesce(a["evidence_sha256"], F.lit("")))
    df = hold(df, _clean=F.transform("_lines", tx.rstrip))

    def window_hash(lines: Column) -> Column:
        return F.sha2(tx.join_lines(lines), 256)

    df = _each(df, now=lambda a: F.when(F.col("_lines").isNotNull() & ~(a["line_start"] > n),
                                        window_hash(tx.slice_lines(F.col("_clean"), a["line_start"], a["end"]))),
               span=lambda a: a["end"] - a["line_start"] + 1)
    df = _each(df, differs=lambda a: (a["line_start"] > n) | ((a["expected"] != "") & (a["now"] != a["expected"])))
    lost = lambda a: F.coalesce(F.col("_lines").isNotNull() & a["differs"] & (a["expected"] != "") & (n >= a["span"]), F.lit(False))
    df = hold(df, _spans=F.array_distinct(F.transform(F.filter("_asked", lost), lambda a: a["span"])))
    df = hold(df, _index=F.transform("_spans", lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: window_hash(F.slice("_clean", i, k)))))
    df = _each(df, moved=lambda a: F.when(lost(a), F.nullif(F.array_position(
        F.element_at("_index", F.array_position(F.col("_spans"), a["span"]).cast("int")), a["expected"]).cast("int"), F.lit(0))))
    df = _answered(citations, df, question, "now", "differs", "moved")
    gone = F.col("_n").isNull()
    status = (F.when(unsafe_reason(F.col("path")).isNotNull(), "unsafe_path").when(gone, "missing")
              .when(F.col("_differs"), "stale").otherwise("verified"))
    changed = F.when(gone | (F.col("line_start") > F.col("_n")), True).otherwise(
        (F.coalesce("file_sha256", F.lit("")) != "") & (F.col("file_sha256") != F.col("_sha")))
    return (df.withColumn("status", status).withColumn("relocated_line", F.col("_moved"))
            .withColumn("file_changed", F.coalesce(changed, F.lit(False)))
            .withColumn("lines_changed", gone | F.coalesce("_differs", F.lit(False)))
            .withColumn("file_sha256_current", F.col("_sha"))
            .withColumn("evidence_sha256_current", F.col("_now"))
            .withColumn("message", verify_message()).drop("_n", "_sha", "_now", "_differs", "_moved"))


def verify_message() -> Column:
    s = F.col("status")
    moved = F.format_string("Cited code moved to line %d. Re-run analysis to refresh the citation.",
                            F.col("relocated_line"))
    return (F.when(s.isin("missing", "unsafe_path"), "Source file no longer exists in the repository.")
            .when((s == "stale") & F.col("relocated_line").isNotNull(), moved)
            .when(s == "stale", "Source changed after this finding was generated. Re-run analysis.")
            .when(F.col("file_changed"), "Cited lines unchanged; other parts of this file changed since indexing.")
            .otherwise("Source confirmed against current repository."))


def reverify_findings(findings: DataFrame, locations: DataFrame, files: DataFrame) -> DataFrame:
    """New status per finding: the worst of its own citation and of all its locations.

    ``findings``: finding_id plus the citation columns; ``locations``: the same, many per finding.
    """
    own = verify(findings, files).withColumn("_own", F.lit(True))
    rest = verify(locations, files).withColumn("_own", F.lit(False))
    both = own.unionByName(rest, allowMissingColumns=True)
    out = both.groupBy("finding_id").agg(
        worst_status(F.col("status")).alias("status"),
        F.max(F.when(F.col("_own"), F.col("status"))).alias("own_status"),
        F.max(F.when(F.col("_own"), F.col("message"))).alias("own_message"),
        F.max(F.when(F.col("_own"), F.col("relocated_line"))).alias("relocated_line"))
    note = "One or more duplicate locations changed. Re-run analysis."
    return out.withColumn("message", F.when(F.col("status") != F.col("own_status"), note)
                          .otherwise(F.col("own_message"))).drop("own_message")
