"""Run and timeline queries over ``events``: repository = user, stage = event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcegrain.operators import runs as S
from sourcegrain.plans.registry import query
from sourcegrain.sources.corpus import table

_TL = """tl AS (SELECT CAST(user_id AS VARCHAR) AS repo_id, event_id, ts, event_type AS stage, value, (event_id % 3)::INT AS depth,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' ELSE 'complete' END AS status,
 CASE WHEN event_id % 2 = 0 THEN concat('lead', event_id % 4) ELSE concat('lead', event_id % 4, '.m', event_id % 5) END AS agent, (event_id % 3)::INT AS analysis_no FROM events)"""


def timeline(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return shape(e)


def shape(e):
    t, i = F.col("event_type"), F.col("event_id")
    lead = F.concat(F.lit("lead"), (i % 4).cast("string"))
    return e.select(F.col("user_id").cast("string").alias("repo_id"), "event_id", "ts", t.alias("stage"), "value", (i % 3).cast("int").alias("depth"),
                    F.when(t == "signup", "queued").when(t == "view", "processing").when(t == "error", "failed").when(t == "click", "skipped").otherwise("complete").alias("status"),
                    F.when(i % 2 == 0, lead).otherwise(F.concat(lead, F.lit(".m"), (i % 5).cast("string"))).alias("agent"), (i % 3).cast("int").alias("analysis_no"),
                    i.alias("id"))


@query("timeline_last_entries", "S2", f"""WITH {_TL} SELECT repo_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS n FROM tl) WHERE n <= {S.TIMELINE_MAX}""")
def timeline_last_entries(spark, sf_dir):
    return S.last_entries(timeline(spark, sf_dir)).select("repo_id", "event_id")


@query("latest_runs", "S3", f"""WITH {_TL} SELECT repo_id, analysis_no, agent, max(event_id) AS id, max_by(status, event_id) AS status FROM tl GROUP BY 1, 2, 3""")
def latest_runs(spark, sf_dir):
    return S.latest_runs(timeline(spark, sf_dir)).select("repo_id", "analysis_no", "agent", "id", "status")


@query("run_status_rollup", "S4", f"""WITH {_TL}, x AS (SELECT *, strpos(agent, '.') > 0 AS member FROM tl) SELECT repo_id,
 count(*) FILTER (WHERE NOT member AND status IN ('complete', 'failed', 'running')) AS leads_run, count(*) FILTER (WHERE NOT member AND status = 'complete') AS leads_complete,
 count(*) FILTER (WHERE member) AS members, count(*) FILTER (WHERE member AND status = 'complete') AS members_complete, count(*) FILTER (WHERE member AND status = 'skipped') AS members_skipped,
 count(*) FILTER (WHERE member AND status = 'failed') AS members_failed, coalesce(max(event_id % 7 % 3 + 1) FILTER (WHERE NOT member), 0)::INT AS lead_waves FROM x GROUP BY 1""")
def run_status_rollup(spark, sf_dir):
    return S.status_rollup(timeline(spark, sf_dir).withColumn("wave", (F.col("event_id") % 7 % 3 + 1).cast("int")))


@query("stages_seen", "S5", f"""WITH {_TL} SELECT repo_id, stage, row_number() OVER (PARTITION BY repo_id ORDER BY f) AS stage_no FROM (SELECT repo_id, stage, min((ts, event_id)) AS f FROM tl GROUP BY 1, 2)""")
def stages_seen(spark, sf_dir):
    return S.stages_seen(timeline(spark, sf_dir))


@query("timeline_by_depth", "S6", f"""WITH {_TL} SELECT repo_id, event_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, event_id DESC) AS n FROM tl WHERE depth <= 1) WHERE n <= 30""")
def timeline_by_depth(spark, sf_dir):
    return S.recent_events(timeline(spark, sf_dir), 1).select("repo_id", "event_id", "depth")


@query("interrupted_runs", "S7", f"""WITH {_TL}, s AS (SELECT repo_id, max(ts) AS updated_at, max_by(status, (ts, event_id)) AS status FROM tl GROUP BY 1)
 SELECT repo_id, updated_at, 'failed' AS status FROM s WHERE status IN ('queued', 'processing') AND updated_at <= (SELECT max(ts) FROM tl) - INTERVAL 7200 SECOND""")
def interrupted_runs(spark, sf_dir):
    return S.interrupted(timeline(spark, sf_dir), 7200)


@query("run_durations", "S8", f"""WITH {_TL} SELECT event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY repo_id))) // 1000 AS elapsed_ms FROM tl""")
def run_durations(spark, sf_dir):
    return S.durations(timeline(spark, sf_dir)).select("event_id", "elapsed_ms")


@query("event_rate_windows", "S9", f"""WITH {_TL} SELECT date_trunc('hour', ts) AS window_start, stage, count(*) AS n, round(sum(value), 4) AS total FROM tl GROUP BY 1, 2""")
def event_rate_windows(spark, sf_dir):
    return S.windowed_rates(timeline(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query("event_sessions", "S9", f"""WITH {_TL}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM tl),
 h AS (SELECT *, sum(b) OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS sid FROM g)
 SELECT repo_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM h GROUP BY repo_id, sid""")
def event_sessions(spark, sf_dir):
    return S.sessions(timeline(spark, sf_dir))


@query("next_analysis_number", "S10", f"""WITH {_TL} SELECT repo_id, max(analysis_no) + 1 AS analysis_no, 'processing' AS status FROM tl GROUP BY 1""")
def next_analysis_number(spark, sf_dir):
    return S.next_analysis(timeline(spark, sf_dir))
