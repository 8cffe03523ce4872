"""A stream over the same rows gives the same result as the batch job."""

import tempfile

from pyspark.sql import functions as F

from sourcegrain.operators import rules as R
from sourcegrain.operators import runs
from sourcegrain.plans.runs import shape
from sourcegrain.sources.corpus import code_files, explode_lines, with_lines
from sourcegrain.sources.listing import classify
from sourcegrain.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_incremental_scan_equals_batch(spark):
    src, out, ck = (tempfile.mkdtemp(prefix="sourcegrain-") for _ in range(3))
    files = classify(code_files(spark, SF)).select("repo_id", "path", "language", "kind", "content").where("kind = 'source'")
    files.repartition(3).write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    jobs.write_claims(jobs.scan_arriving(jobs.stream_table(spark, src, schema, per_trigger=1)), out, ck).awaitTermination(180)
    got = {(r.repo_id, r.path, r.line_no, r.rule_id) for r in spark.read.parquet(out).collect()}
    batch = R.scan(explode_lines(with_lines(spark.read.parquet(src)), "repo_id", "path", "kind", "language"))
    assert got == {(r.repo_id, r.path, r.line_no, r.rule_id) for r in batch.collect()} and got


def test_a_file_that_arrives_again_replaces_its_claims(spark):
    src, out, ck = (tempfile.mkdtemp(prefix="sourcegrain-") for _ in range(3))
    schema = "repo_id string, path string, language string, kind string, content string"
    bad, good = "const a = 1\neval(userInput)\n", "const a = 1\n"

    def arrive(**contents):
        rows = [("r", f"{name}.js", "javascript", "source", text) for name, text in contents.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        arriving = jobs.stream_table(spark, src, spark.read.parquet(src).schema)
        jobs.write_scans(arriving, out, ck).awaitTermination(180)
        return sorted((r.path, r.line_no) for r in jobs.current_claims(spark, out).collect() if r.rule_id == "unsafe-eval")

    assert arrive(a=bad, b=bad, c=good) == [("a.js", 2), ("b.js", 2)]
    assert arrive(a=good, c="x = 2\n" + bad) == [("b.js", 2), ("c.js", 3)]
    assert arrive(b="\n\n" + bad) == [("b.js", 4), ("c.js", 3)]


def test_hourly_rates_equal_batch(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = shape(jobs.stream_table(spark, SF, schema, "events.parquet"))
    q = jobs.hourly_rates(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = runs.windowed_rates(shape(spark.read.parquet(f"{SF}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda r: (str(r.window_start), r.stage, r.n)
    assert sorted(map(key, spark.table("rates").collect())) == sorted(map(key, batch.collect()))
