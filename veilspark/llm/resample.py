"""Operator 12, target-distribution importance resampling by hashed n-grams.

Every text is a bag of n-grams of 1 to 3 words, hashed into buckets by the
CRC-32 of their bytes.  A bucket that the target holds more often than the raw
corpus has a positive gain; a document's weight is the sum of the gains of its
n-grams.  Gumbel noise, a function of seed and doc_id, is added to the weights;
the highest scores are a draw without replacement in proportion to the
weights' exponentials, and a rerun draws the same.

The CRCs come from prefixes (``crc_ngrams``): a normalised text is scanned
once for its running CRCs, and any n-gram's CRC follows from two of them.

Plan: one pass over the texts of corpus and target counts the buckets (each
task sends one row a bucket at most), the table of gains (``buckets`` rows,
fixed) goes to the workers, a second pass scores.  Ranks come from a range
partitioning with counts per partition summed up, so no task sees all scores;
rows that are equal in everything are ranked as one row with a count.

Defined results: null and empty texts have no n-grams, weight 0 and can't be
drawn (fewer than ``least_words`` words); a null doc_id draws its noise as an
empty id and comes after all others in ties; documents with equal ids are
scored row by row, equal rows get consecutive ranks; an empty corpus gives no
row, an empty target only moves the gains; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, shipped, tidied, written
from .words import bytes_of, text_slices, words_of

BUCKETS = 10_000
MOST_WORDS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: copies of one row that are numbered in one go when equal rows are told apart again
LOT = 10_000

COUNTS = "bucket int, n long"
WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def _bags(batches, buckets: int, most: int):
    """Per slice of texts: the slice, the texts' numbers of words, and for each n the first words and buckets."""
    import numpy as np

    from .crc_ngrams import ngram_crcs

    for part in text_slices(batches, "text"):
        words, counts = [], []
        for data in bytes_of(part.column("text")):
            got = words_of(data)
            counts.append(len(got))
            words += got
        counts = np.array(counts, np.int64)
        yield part, counts, [(first, crcs % np.uint32(buckets)) for first, crcs in ngram_crcs(words, counts, most)]


def _counter(buckets: int, most: int):
    def count(batches):
        import numpy as np

        total = np.zeros(buckets, np.int64)
        for _, _, grams in _bags(batches, buckets, most):
            for _, bucket in grams:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        if len(held):
            yield arrow_batch([held, total[held]], arrow_schema(COUNTS))

    return tidied(count)


def _weigher(gains, buckets: int, most: int):
    def weigh(batches):
        import numpy as np

        gain = np.array(gains.value, np.int64)
        for part, counts, grams in _bags(batches, buckets, most):
            by_word = np.zeros(int(counts.sum()), np.int64)
            features = np.zeros(len(counts), np.int64)
            for size, (first, bucket) in enumerate(grams, 1):
                by_word[first] += gain[bucket]
                features += np.maximum(counts - size + 1, 0)
            sums = np.concatenate([[0], np.cumsum(by_word)])
            ends = np.cumsum(counts)
            weights = sums[ends] - sums[ends - counts]
            yield arrow_batch([part.column("doc_id"), counts, features, weights], arrow_schema(WEIGHED))

    return tidied(weigh)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """``(bucket, n)``: n-grams of all texts by bucket."""
    shipped(texts.sparkSession)
    return (texts.select("text").mapInArrow(_counter(buckets, most), COUNTS)
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """``(bucket, gain)`` for every bucket: thousandths of the log ratio of its smoothed shares."""
    spark = docs.sparkSession
    both = (bucket_counts(docs, buckets, most).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .unionByName(bucket_counts(target, buckets, most).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
            .unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"),
                                                     F.lit(0).cast("long").alias("t"))))
    per = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = per.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()

    def real(name):
        return F.col(name).cast("double")

    ratio = ((real("t") + 1) * float(total["s"] + buckets)) / ((real("s") + 1) * float(total["t"] + buckets))
    return per.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""
    spark = shipped(docs.sparkSession)
    # the table has exactly `buckets` rows, whatever the corpus
    table = [g["gain"] for g in gains(docs, target, buckets, most).orderBy("bucket").collect()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_weigher(spark.sparkContext.broadcast(table), buckets, most), WEIGHED)


def ranked(rows: DataFrame, order, tag: str) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... by ``order``, without one task seeing all of them.

    Rows are range partitioned, counted by partition, and numbered inside
    each.  ``rows`` must have a ``copies`` column; a row's rank is that of its
    first copy.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .withColumn("_part", F.spark_partition_id()), tag)
    from pyspark.sql import Window

    # one row a partition: bounded by the number of shuffle partitions
    before = (laid.groupBy("_part").agg(F.sum("copies").alias("_all"))
              .select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before")))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (laid.join(before, "_part")
            .withColumn("rank", F.col("_before") + F.coalesce(F.sum("copies").over(inside), F.lit(0)) + 1)
            .drop("_part", "_before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null for those not drawn."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    uniform = (noise.cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = written(weigh(docs, target).withColumn("score", score), "scored")
    fit = F.col("n_words") >= least_words
    n = scored.agg(F.count(F.when(fit, 1)).alias("n")).first()["n"]
    drawn = percent * n // 100
    equal = (scored.where(fit).groupBy("doc_id", "n_features", "weight", "score")
             .agg(F.count("*").alias("copies")))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc()]
    placed = ranked(equal, order, "ranked")
    # equal rows get one rank each again, some thousands at a time
    lots = placed.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT))))
    inside = F.sequence(F.lit(0).cast("long"), F.least(F.lit(LOT).cast("long"), F.col("copies") - F.col("_lot") * LOT) - 1)
    each = (lots.withColumn("_at", F.explode(inside))
            .withColumn("rank", F.col("rank") + F.col("_lot") * LOT + F.col("_at")))
    columns = ["doc_id", "n_features", "weight", "score"]
    return each.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """``doc_id, rank`` of the drawn documents, best first by rank."""
    return resample(docs, target, **settings).where(F.col("rank").isNotNull()).select("doc_id", "rank")
