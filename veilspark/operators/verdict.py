"""Join of externally produced yes/no PII verdicts (e.g. from a model judge).

The model call itself is outside Spark; its verdicts arrive as a table
keyed by message text.  Of several verdicts on one text any "detected" wins,
and a missing verdict, a null one or a null text counts as PII, the fail-safe
default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.message import text_digest
from .cells import named

VERDICT_PREFIX = "[PII DETECTED BY LLM] "


def verdict_join(messages: DataFrame, verdicts: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` + ``is_pii``; ``verdicts`` has ``text, verdict``."""
    # of conflicting verdicts any "detected" wins; one row a text, so the join
    # neither repeats messages nor needs them distinct, and skewed texts split.
    # Texts are told apart by their SHA-256, so keys have 32 bytes however long they are.
    v = verdicts.where(F.col("text").isNotNull()).groupBy(text_digest("text").alias("_digest")).agg(
        F.max(F.coalesce(F.col("verdict") == "PII_DETECTED", F.lit(True))).alias("_judged"))
    judged = messages.withColumn("_digest", text_digest(text_col)).join(v, "_digest", "left")
    return judged.withColumn("is_pii", F.coalesce("_judged", F.lit(True))).select(*[named(c) for c in messages.columns], "is_pii")


def apply_verdict_policy(judged: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """``warn_and_log`` prefixes flagged messages; ``block`` drops them."""
    if policy == "block":
        return judged.where(~F.col("is_pii"))
    if policy == "warn_and_log":
        return judged.withColumn(
            "output", F.when(F.col("is_pii"), F.concat(F.lit(VERDICT_PREFIX), F.col(text_col)))
            .otherwise(F.col(text_col)))
    raise ValueError("policy must be warn_and_log or block")
