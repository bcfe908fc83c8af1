"""Operator 2, mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) take the weights in turn and
share the corpus total; a source's target stops at ``most_copies`` times its
size and the excess goes to the others by weight until none is above.

Sampling: within a source every document expects ``target / source size``
copies.  Documents are lined up (size class, then bucket, then size and id),
their expected copies are summed along the line, one random offset is added,
and a document is emitted once per integer boundary its interval crosses.
Lining up by size makes the sample a stratified one, so the words taken stay
close to the target.

Scale: the line's positions come from counts per (source, size class, bucket)
and a row number inside each such bin.  The number of buckets follows the row
count, so a bin stays near ``rows_per_bin`` rows however large a source or a
group of equal documents is; only the bins' counts meet per source.  Offsets
and buckets come from MD5 of the seed, source and id: reruns agree.

Defined results: a null text has size 0; a null source is a source of its
own; repeated rows are separate documents; a source without words has target
0 and takes none; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
ROWS_PER_BIN = 100_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """Per source ``(_source, source_size, target)``.  The windows run over one row a source."""
    # grouped first: what the single-task windows read is one row for each source
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("_source").isNull(), "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.lit(float(most_copies)) * F.col("source_size"))
    # sources by the level at which they reach their cap: those before the
    # first that stays below it are capped, the others share what is left
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    per = per.withColumn("_level", (F.sum("source_size").over(W.partitionBy()).cast("double")
                                    - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    ratio = F.col("_cap") / F.col("_w")
    first_open = F.min(F.when(F.col("_level") <= ratio, F.struct(ratio.alias("r"), F.col("_level").alias("l"))))
    per = per.withColumn("_level", first_open.over(W.partitionBy())["l"])
    return per.select("_source", "source_size",
                      F.least(F.col("_level") * F.col("_w"), F.col("_cap")).alias("target"))


def _unit(*cols):
    """A number in [0, 1) from the MD5 of the columns."""
    return F.conv(F.substring(F.md5(F.concat(*cols)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES, rows_per_bin: int = ROWS_PER_BIN,
        seed: str = SEED, carry: bool = False) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, copies`` and, with
    ``carry``, the input row as struct ``row``."""
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sizes = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep), "mix")
    # "ssource" or "n": a key without nulls, so that plain equi-joins do
    sizes = sizes.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n")))
    buckets = max(1, math.ceil(sizes.count() / rows_per_bin))
    lined = sizes.withColumn("_class", F.length(F.bin("size"))).withColumn(
        "_bucket", F.floor(_unit(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) * buckets).cast("int"))
    bins = lined.groupBy("_key", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(
        W.partitionBy("_key").orderBy("_class", "_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goal = targets(sizes, weights, most_copies).withColumn(
        "_key", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))).drop("_source")
    bins = bins.join(goal, "_key").withColumn("_u", _unit(F.lit(seed + "/"), F.col("_key"))).withColumn(
        "_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    inside = F.row_number().over(W.partitionBy("_key", "_class", "_bucket").orderBy("size", "doc_id"))
    placed = lined.withColumn("_inside", inside).join(bins, ["_key", "_class", "_bucket"])
    at = F.col("_before") + F.col("_inside")
    copies = F.floor(at * F.col("_rate") + F.col("_u")) - F.floor((at - 1) * F.col("_rate") + F.col("_u"))
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select("doc_id", "size", "source_size", "target",
                         (F.col("copies") * F.col("size")).alias("taken"), "copies", *(["row"] if carry else []))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each carried row as often as it was taken."""
    return mixed.where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("row.*")
