"""Run and timeline analytics over an append-only event table (repo_id, event_id, ts, stage, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMELINE_MAX = 250


def last_entries(timeline: DataFrame, keep: int = TIMELINE_MAX) -> DataFrame:
    """The last ``keep`` entries per repository. Row-number limits prune before the shuffle."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return timeline.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest row per (repo_id, analysis_no, agent): the later id wins."""
    rest = F.struct(*[c for c in runs.columns if c not in ("repo_id", "analysis_no", "agent")])
    return runs.groupBy("repo_id", "analysis_no", "agent").agg(F.max_by(rest, "id").alias("r")).select("repo_id", "analysis_no", "agent", "r.*")


def status_rollup(runs: DataFrame) -> DataFrame:
    """Lead and member counts by status and the last wave of leads per repository, 0 without any; members are named ``lead.member``."""
    member = F.col("agent").contains(".")
    is_ = lambda s: F.col("status") == s
    return runs.groupBy("repo_id").agg(
        F.count_if(~member & F.col("status").isin("complete", "failed", "running")).alias("leads_run"), F.count_if(~member & is_("complete")).alias("leads_complete"),
        F.count_if(member).alias("members"), F.count_if(member & is_("complete")).alias("members_complete"),
        F.count_if(member & is_("skipped")).alias("members_skipped"), F.count_if(member & is_("failed")).alias("members_failed"),
        F.coalesce(F.max(F.when(~member, F.col("wave"))), F.lit(0)).alias("lead_waves"))


def stages_seen(timeline: DataFrame) -> DataFrame:
    """Distinct stages per repository with the time they were first seen."""
    first = timeline.groupBy("repo_id", "stage").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    w = Window.partitionBy("repo_id").orderBy("f")
    return first.select("repo_id", "stage", F.row_number().over(w).alias("stage_no"))


def recent_events(timeline: DataFrame, max_depth: int | None = None, last: int = 30) -> DataFrame:
    rows = timeline if max_depth is None else timeline.where(F.coalesce("depth", F.lit(0)) <= max_depth)
    return last_entries(rows, last)


def interrupted(timeline: DataFrame, idle_seconds: int) -> DataFrame:
    """Open repositories without an event for ``idle_seconds`` before the newest event of all."""
    state = timeline.groupBy("repo_id").agg(F.max("ts").alias("updated_at"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    newest = timeline.agg(F.max("ts")).scalar()
    stale = F.col("status").isin("queued", "processing") & (F.col("updated_at") <= newest - F.make_dt_interval(secs=F.lit(idle_seconds)))
    return state.where(stale).select("repo_id", "updated_at", F.lit("failed").alias("status"))


def durations(timeline: DataFrame) -> DataFrame:
    """Milliseconds since the first event of the repository, as an aggregate joined back."""
    start = timeline.groupBy("repo_id").agg(F.min("ts").alias("_start"))
    return timeline.join(start, "repo_id").withColumn("elapsed_ms", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 1000)).drop("_start")


def next_analysis(runs: DataFrame) -> DataFrame:
    return runs.groupBy("repo_id").agg((F.coalesce(F.max("analysis_no"), F.lit(0)) + 1).alias("analysis_no")).withColumn("status", F.lit("processing"))


def windowed_rates(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Events per hour and stage; works on a batch or a stream."""
    return (events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour").alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select(F.col("w.start").alias("window_start"), "stage", "n", "total"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    """Bursts of events per repository separated by ``gap``."""
    return (events.withWatermark("ts", watermark).groupBy("repo_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
            .select("repo_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))
