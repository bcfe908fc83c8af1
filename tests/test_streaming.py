"""Streaming operators: stream == batch, windowed counts, repeat suppression."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from veilspark.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def _run(spark, sdf, name, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_policy_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stream = (spark.readStream.schema(batch.schema).option("pathGlobFilter", "documents.parquet")
              .option("maxFilesPerTrigger", 1).parquet(SF).select("doc_id", "text"))
    got = _run(spark, ST.policy_stream(stream), "pol").select("doc_id", "severity", "output", "log_level")
    exp = ST.policy_stream(batch).select("doc_id", "severity", "output", "log_level")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_entity_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.col("html").alias("text"))
    schema = spark.read.parquet(f"{SF}/pages.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "pages.parquet").parquet(SF)
              .select("page_id", F.col("html").alias("text")))
    got = _run(spark, ST.entity_stream(stream), "ents").select("page_id", "masked", F.size("spans").alias("n"))
    exp = ST.entity_stream(batch).select("page_id", "masked", F.size("spans").alias("n"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_windowed_counts_and_suppression(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    d = tempfile.mkdtemp(prefix="veil-stream-")
    try:
        src = os.path.join(d, "in")
        (events.select("ts", F.concat(F.lit("user "), F.col("user_id").cast("string"),
                                      F.lit(" from 10.0.0."), (F.col("user_id") % 5).cast("string")).alias("text"))
         .write.parquet(src))
        schema = spark.read.parquet(src).schema
        st = spark.readStream.schema(schema).parquet(src)
        # complete mode shows every window; append mode would hold back the
        # windows the watermark has not yet closed
        counts = _run(spark, ST.severity_counts(st, "ts", window="1 day", watermark="1 hour"), "sev_counts",
                      mode="complete")
        total = counts.agg(F.sum("n")).first()[0]
        assert total == events.count()
        assert {r.severity for r in counts.select("severity").distinct().collect()} == {"sensitive"}
        uniq = _run(spark, ST.suppress_repeats(spark.readStream.schema(schema).parquet(src), "text", "ts",
                                               "100000 days"), "uniq")
        assert uniq.count() == spark.read.parquet(src).select("text").distinct().count()
    finally:
        shutil.rmtree(d, ignore_errors=True)


def test_log_sink_writes_each_message_once_over_a_failed_batch(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    texts = [f"message {i} from 10.0.0.{i}" if i % 3 else f"ssn 123-45-67{i:02d}" for i in range(30)]
    schema = "id int, text string"
    spark.createDataFrame(list(enumerate(texts)), schema).repartition(3).write.parquet(src)

    def killed(batch_id):
        raise RuntimeError("killed after the write")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    query = ST.log_sink(stream(), out, ckpt, after=killed)
    try:
        query.awaitTermination()
        raise AssertionError("the batch should have failed")
    except Exception as e:  # noqa: BLE001
        assert "killed after the write" in str(e)
    assert ST.read_log(spark, out).count() > 0          # the failed batch had written already
    ST.log_sink(stream(), out, ckpt).awaitTermination()
    spark.createDataFrame([(99, "late 10.0.0.99")], schema).write.mode("append").parquet(src)
    ST.log_sink(stream(), out, ckpt).awaitTermination()
    got = ST.read_log(spark, out)
    assert sorted(r.id for r in got.collect()) == [*range(30), 99]
    exp = ST.policy_stream(spark.read.parquet(src)).select("id", "output", "severity")
    assert got.select("id", "output", "severity").exceptAll(exp).count() == 0
    assert got.select("batch_id").distinct().count() >= 3


def test_log_sink_can_drop_blocked_messages(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(0, "clean"), (1, "ssn 123-45-6789"), (2, None)], "id int, text string").write.parquet(src)
    stream = spark.readStream.schema("id int, text string").parquet(src)
    ST.log_sink(stream, out, str(tmp_path / "c"), drop=True).awaitTermination()
    assert sorted(r.id for r in ST.read_log(spark, out).collect()) == [0, 2]
