"""Structured Streaming jobs: incremental scans, timelines, latest runs, idle detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sourcegrain.operators import rules as R
from sourcegrain.operators import runs
from sourcegrain.sources.corpus import explode_lines, with_lines
from sourcegrain.sources.keyed import FileTable


def stream_table(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", per_trigger: int = 8) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(path))


def scan_arriving(files: DataFrame) -> DataFrame:
    """Rule claims of arriving files (repo_id, path, language, kind, content): stateless, one pass over the lines."""
    lines = explode_lines(with_lines(files), "repo_id", "path", "kind", "language")
    return R.scan_lines(lines)


def write_claims(claims: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append; the batch id is part of the path, so a repeated batch replaces itself."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return claims.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_scans(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Scan arriving files and keep what ``current_claims`` needs to replace the claims of a file that arrives again.

    Each batch writes the keys of its files and their claims, both under the batch id: nothing old is rewritten, and a
    repeated batch replaces itself. A file that stands twice in one batch counts once, with its greatest content hash.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        one = batch.groupBy("repo_id", "path").agg(F.max_by(F.struct(*batch.columns), F.sha2("content", 256)).alias("f")).select("f.*")
        kept = one.persist()
        kept.select("repo_id", "path").write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")
        scan_arriving(kept).write.mode("overwrite").parquet(f"{out}/claims/batch={batch_id}")
        kept.unpersist()
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_claims(spark: SparkSession, out: str) -> DataFrame:
    """The claims of each file's latest scan; a file whose latest scan found nothing has none."""
    latest = spark.read.parquet(f"{out}/files").groupBy("repo_id", "path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/claims").join(latest, ["repo_id", "path", "batch"]).drop("batch")


def keep_current(files: DataFrame, table: FileTable, checkpoint: str) -> StreamingQuery:
    """Bring a stored file table up to date with arriving files; a null content deletes its file.

    The table compares content hashes, so a batch that is repeated after a failure changes nothing.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, whole=False)
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_rates(events: DataFrame) -> DataFrame:
    return runs.windowed_rates(events)


def latest_status(events: DataFrame) -> DataFrame:
    """Update-mode aggregate: newest status per repository and agent."""
    return events.groupBy("repo_id", "agent").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))


def idle_runs(events: DataFrame, idle_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Emit a repository once its open run has had no event for ``idle_seconds`` of event time."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, status = state.get
            state.remove()
            if status in ("queued", "processing"):
                yield pd.DataFrame({"repo_id": [key[0]], "updated_at": [pd.Timestamp(last, unit="us")], "status": ["failed"]})
            return
        last, status = state.get if state.exists else (0, "")
        for pdf in batches:
            newest = pdf.loc[pdf["ts"].idxmax()]
            at = int(newest["ts"].value // 1000)
            if at >= last:
                last, status = at, str(newest["status"])
        state.update((last, status))
        due = last // 1000 + idle_seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    return (events.withWatermark("ts", watermark).groupBy("repo_id").applyInPandasWithState(
        step, "repo_id string, updated_at timestamp, status string", "last long, status string", "append", GroupStateTimeout.EventTimeTimeout))
