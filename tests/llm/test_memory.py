"""What operators send to Python workers and leave in them."""

from pyspark.sql import functions as F

from sourcegrain.llm import common, katz, quality
from sourcegrain.session import small_batches

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _docs(spark, n=12):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))


def test_katz_sends_texts_in_small_batches(spark, monkeypatch):
    seen, before, plain = [], spark.conf.get(BATCH), katz.stored

    def stored(df):
        seen.append(int(spark.conf.get(BATCH)))
        return plain(df)
    monkeypatch.setattr(katz, "stored", stored)
    assert katz.scores(_docs(spark)).count() == 12
    assert seen[0] <= 1000 and spark.conf.get(BATCH) == before


def test_small_batches_never_raises_the_limit(spark):
    before = spark.conf.get(BATCH)
    for own, inside in (("0", "1000"), ("50", "50"), ("10000", "1000")):
        spark.conf.set(BATCH, own)
        with small_batches(spark):
            assert spark.conf.get(BATCH) == inside
        assert spark.conf.get(BATCH) == own
    spark.conf.set(BATCH, before)


def test_quality_sends_no_document_through_python(spark):
    rows = quality.featured(_docs(spark).withColumn("other", F.lit("x")))
    assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    model = quality.Model(*[quality.np.ones(quality.WIDTH)] * 3, 0.0)
    scored = quality.score_featured(rows, model)
    assert "MapInArrow" not in scored._jdf.queryExecution().executedPlan().toString()
    got = scored.select("doc.*", "score").collect()
    assert {(r.doc_id, r.other) for r in got} == {(i, "x") for i in range(12)} and all(0 <= r.score <= 1 for r in got)


def test_memory_is_given_back_once_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.mapped(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and len(calls) == 1
    assert common.grouped(lambda t: t * 2)(4) == 8 and len(calls) == 2
