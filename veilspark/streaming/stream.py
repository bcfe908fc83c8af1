"""Structured Streaming forms of the message and span operators.

The detection, masking and policy logic are per-row column expressions,
so the streaming operators are the batch expressions on a streaming
DataFrame.  Aggregations use event-time windows with a watermark, so state
is bounded and late rows follow Spark's watermark rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, VeilConfig
from ..functions import message as M
from ..functions import spans as S
from ..operators.detect import kept_spans


def policy_stream(stream: DataFrame, text_col: str = "text", policy: str = "mask_and_log",
                  cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Severity, sink output and log level for every message (stateless)."""
    t = F.col(text_col)
    with_sev = stream.withColumn("severity", M.severity_of(t, cfg))
    s = F.col("severity")
    return with_sev.withColumn("output", M.policy_output(t, s, policy, M.masked_of(t, cfg))).withColumn(
        "log_level", M.log_level(t, s, policy))


def drop_blocked(stream: DataFrame, text_col: str = "text", cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Filter form of BLOCK: messages with any PII never reach the sink."""
    return stream.where(M.severity_of(F.col(text_col), cfg).isNull())


def entity_stream(stream: DataFrame, text_col: str = "text", cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Kept spans and the span-masked text of every row (stateless)."""
    from ..operators.detect import bind_column

    spans = kept_spans(F.col(text_col), cfg)
    with_spans = bind_column(stream, "spans", spans)
    return with_spans.withColumn("masked", S.mask_with_spans(F.col(text_col), F.col("spans")))


def _event_time(stream: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; parquet sources often carry TIMESTAMP_NTZ."""
    return stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def severity_counts(stream: DataFrame, ts_col: str, text_col: str = "text", window: str = "10 minutes",
                    slide: str | None = None, watermark: str = "10 minutes", cfg: VeilConfig = DEFAULT) -> DataFrame:
    """Messages per severity class per event-time window (clean included)."""
    sev = F.coalesce(M.severity_of(F.col(text_col), cfg), F.lit("clean"))
    w = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    return (
        _event_time(stream, ts_col).withWatermark(ts_col, watermark)
        .groupBy(w.alias("window"), sev.alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def suppress_repeats(stream: DataFrame, text_col: str, ts_col: str, watermark: str = "10 minutes") -> DataFrame:
    """Drop repeats of the same text seen within the watermark delay (the
    streaming stand-in for a detection cache: repeated texts are scanned
    and logged once).  The state holds digests, not texts."""
    marked = _event_time(stream, ts_col).withColumn("_digest", M.text_digest(text_col))
    return marked.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


#: folder of a batch below the sink's path
BATCH = "batch_id"


def log_sink(stream: DataFrame, path: str, checkpoint: str, text_col: str = "text", policy: str = "mask_and_log",
             cfg: VeilConfig = DEFAULT, drop: bool = False, trigger: dict | None = None, after=None):
    """Write a message stream under a policy; returns the running query.

    Every micro-batch is written to its own folder below ``path``, named by
    the batch and replaced as a whole, so a batch that is run again after a
    failure writes each of its messages once.  ``checkpoint`` keeps the
    offsets: a restarted sink goes on where the last one stopped.  With
    ``drop`` messages that hold personal data are left out, else they go
    through :func:`policy_stream`.  ``trigger`` are the arguments of Spark's
    trigger (default: what is there now, then stop); ``after(batch_id)`` runs
    once a batch is written.  Read the folder back with :func:`read_log`.
    """
    out = drop_blocked(stream, text_col, cfg) if drop else policy_stream(stream, text_col, policy, cfg)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")
        if after is not None:
            after(batch_id)

    return (out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_log(spark, path: str) -> DataFrame:
    """The messages that :func:`log_sink` has written, with the batch that wrote them."""
    return spark.read.parquet(path)
