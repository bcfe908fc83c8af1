"""Operator 3, quality rules [native]: base rules and robust outliers.

Statistics of the whole text are column expressions in the scan's stage.
Documents that pass the base rules become vectors of ``FEATURES`` transformed
statistics, held as integers of 1/1000 so that sums are exact and reruns agree.
For each language and source a minimum-covariance-determinant estimate is
made by concentration steps: from three starts (medians with the floor scatter;
mean and covariance of all; medians with the spread of the middle half), the
smallest majority ``(n + p + 1) / 2`` of documents nearest to the estimate gives
the next mean and covariance, until the determinant stops falling; the
smallest determinant of all wins.  So up to nearly half of a group may be junk.  The
estimate is then reweighted in the usual way (documents within the 97.5 %
ellipsoid) and a document is rejected when its squared Mahalanobis distance is
above ``CUTOFF``.

``FLOORS`` are the smallest spreads that count: they are added to the
diagonal, which keeps estimates regular where most documents have no symbols
or repeats at all, and harmless deviations harmless.

Scale: each step is one pass over the narrow table of vectors.  Quantiles come
from counts per distance bin, moments from partial sums, so what is shuffled
are a few hundred rows a group and task; estimates are one row a group and
start, written and joined back by the group's key (broadcast by the planner where
their measured size allows, else a join whose skewed keys it splits).  A step
reads the groups and starts that still fall.  Languages and sources
with fewer than ``MIN_GROUP`` documents share an estimate within the language,
then overall; where even that is too small there is no verdict.

Defined results: null text: no words (base rule fails); null lang or source
are groups of their own; equal documents get equal verdicts; an empty table
gives no row; other columns are ignored (``keep_good`` passes them through).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, WORD, text_or_empty, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: per feature: the smallest spread (in its own units) that counts
FLOORS = {"log_words": 1.0, "log_word_length": 0.1, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15}
FEATURES = tuple(FLOORS)
UNIT = 1000
#: a determinant falls if it is smaller by this share
FALL = 1e-3
MIN_GROUP = 50
#: chi-squared with five degrees of freedom: 97.5 % and 99.999 % points, and the
#: factor that makes the covariance of the nearest half consistent
CHI2_WEIGHT, CUTOFF, CONSISTENCY = 12.833, 30.856, 1.912
#: middle half of a normal distribution to its spread
HALF_TO_SPREAD = 0.7413
P = len(FEATURES)


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""
    def count(w):
        n = F.size(w)
        keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n > 3, _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), _let(
            F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), in_repeats)).otherwise(0))
        ).otherwise(0)

    def in_repeats(sorted_keys):
        twice = F.filter(sorted_keys, lambda x, j: (F.coalesce(F.get(sorted_keys, j + 1)["k"] == x["k"], F.lit(False))
                                                    | ((j > 0) & F.coalesce(F.get(sorted_keys, j - 1)["k"] == x["k"],
                                                                            F.lit(False)))))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    return _let(words, count)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines, base_failed``."""
    out = docs.withColumn("_t", text_or_empty("text"))
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn("_lines_", lines)
    out = (out
           .withColumn("n_words", F.size("_words").cast("long"))
           .withColumn("word_chars", F.length(F.translate(t, SPACES, "")).cast("long"))
           .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
           .withColumn("_lines", F.size("_lines_").cast("long"))
           .withColumn("n_dup_lines", (F.size("_lines_") - F.size(F.array_distinct("_lines_"))).cast("long"))
           .withColumn("n_repeat_words", _repeated_words(F.col("_words")).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    return out.drop("_t", "_words", "_lines_")


def _vectors(stats: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    made = {
        "log_words": F.log(F.lit(1.0) + F.col("n_words")),
        "log_word_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return stats.withColumns({f"x{i}": F.floor(made[f] * UNIT + 0.5).cast("long") for i, f in enumerate(FEATURES)})


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``g``: the estimation group of each row, null where there are too few documents."""
    lang, source = (F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n")) for c in ("_lang", "_source"))
    rows = rows.withColumn("_lk", lang).withColumn("_sk", source)
    n = rows.where(~F.col("base_failed")).groupBy("_lk", "_sk").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    n = n.withColumn("in_lang", F.sum(small).over(W.partitionBy("_lk")))
    left = F.when((F.col("n") < MIN_GROUP) & (F.col("in_lang") < MIN_GROUP), F.col("n")).otherwise(0)
    # one row for each language and source
    n = n.withColumn("in_all", F.sum(left).over(W.partitionBy()))
    g = (F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\n", F.lit("1"), "_lk", "_sk"))
         .when(F.col("in_lang") >= MIN_GROUP, F.concat_ws("\n", F.lit("2"), "_lk"))
         .when(F.col("in_all") >= MIN_GROUP, F.lit("3")))
    return rows.join(n.select("_lk", "_sk", g.alias("g")), ["_lk", "_sk"], "left").drop("_lk", "_sk")


# SQL text: long arithmetic is parsed once instead of being built operation by operation

PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
ESTIMATE = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in PAIRS] + ["det"]


def _floor(i: int, j: int) -> str:
    return f"{(FLOORS[FEATURES[i]] * UNIT) ** 2 if i == j else 0.0!r}D"


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean ``m_i``, Cholesky factor ``l_i_j`` of the floored covariance and ``det`` per key."""
    sums = [f"sum(x{i}) AS s{i}" for i in range(P)] + [
        f"sum(cast(x{i} * x{j} AS decimal(20,0))) AS s{i}{j}" for i, j in PAIRS]
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *map(F.expr, sums))
    got = got.selectExpr("*", *[f"cast(s{i} AS double) / n AS m{i}" for i in range(P)])
    return _cholesky(got.selectExpr("*", *[
        f"{factor!r}D * (cast(s{i}{j} AS double) / n - m{i} * m{j}) + {_floor(i, j)} AS c{i}{j}" for i, j in PAIRS]), keys)


def _cholesky(got: DataFrame, keys: list[str]) -> DataFrame:
    for j in range(P):
        rest = {i: " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]]) for i in range(j, P)}
        got = got.selectExpr("*", f"sqrt({rest[j]}) AS l{j}{j}")
        got = got.selectExpr("*", *[f"({rest[i]}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)])
    return got.selectExpr(*keys, *ESTIMATE[:-1], " * ".join(f"l{i}{i}" for i in range(P)) + " AS det")


def _distances(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance to each estimate of their group."""
    out = rows.join(params, "g", how)
    for i in range(P):
        rest = " - ".join([f"x{i} - m{i}", *[f"l{i}{j} * y{j}" for j in range(i)]])
        out = out.selectExpr("*", f"({rest}) / l{i}{i} AS y{i}")
    d2 = " + ".join(f"y{i} * y{i}" for i in range(P))
    return out.selectExpr("*", f"{d2} AS d2").drop(*ESTIMATE, *[f"y{i}" for i in range(P)])


def _lower_part(rows: DataFrame, keys: list[str], value: str, needed) -> DataFrame:
    """Per key the smallest integer ``cut`` with ``needed(rows of the key)`` rows or more at or below it."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("all", F.sum("c").over(w))
    return counts.where(F.col("upto") >= needed(F.col("all"))).groupBy(*keys).agg(
        F.min(value).alias("cut"))


def _majority(n: Column) -> Column:
    return F.least(n, F.floor((n + P + 1) / 2))


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates that the steps start from, per ``g`` and ``start``."""
    long = rows.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(P)])).alias("f", "v"))
    quarters = [_lower_part(long, ["g", "f"], "v", lambda n, q=q: F.ceil(n * q / 4)).withColumnRenamed("cut", f"q{q}")
                for q in (1, 2, 3)]
    q = quarters[0].join(quarters[1], ["g", "f"]).join(quarters[2], ["g", "f"])
    spread = (F.col("q3") - F.col("q1")) * HALF_TO_SPREAD
    q = written(q.groupBy("g").agg(*[
        F.max(F.when(F.col("f") == i, x)).cast("double").alias(f"{n}{i}")
        for n, x in (("m", F.col("q2")), ("r", spread)) for i in range(P)]), "mcd-medians")

    def around(wide: float):
        return _cholesky(q.selectExpr("*", *[
            (f"{_floor(i, j)} + {wide!r}D * r{i} * r{i}" if i == j else "0.0D") + f" AS c{i}{j}" for i, j in PAIRS]), ["g"])

    starts = [around(0.0), _moments(rows, ["g"], 1.0), around(1.0)]
    return starts[0].withColumn("start", F.lit(0)).unionByName(starts[1].withColumn("start", F.lit(1))).unionByName(
        starts[2].withColumn("start", F.lit(2)))


def _core_estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group ``g``."""
    keys = ["g", "start", "least"]
    moving = written(_starts(rows).withColumn("least", F.lit(float("inf"))), "mcd")
    steps = []
    while not moving.isEmpty():
        bins = F.floor(F.log2(1.0 + F.col("d2")) * 256).cast("long")
        cut = _lower_part(_distances(rows, moving).withColumn("bin", bins), ["g", "start"], "bin", _majority)
        now = written(moving.join(cut, ["g", "start"]), "mcd-cut")
        core = _distances(rows, now).where(bins <= F.col("cut"))
        steps.append(written(_moments(core, keys, CONSISTENCY), "mcd"))
        moving = steps[-1].where(F.col("det") < F.col("least") * (1 - FALL)).withColumn("least", F.col("det"))
    if not steps:
        return moving.select("g", *ESTIMATE)
    made = steps[0].withColumn("step", F.lit(0))
    for i, step in enumerate(steps[1:], 1):
        made = made.unionByName(step.withColumn("step", F.lit(i)))
    return made.groupBy("g").agg(F.min_by(F.struct(*ESTIMATE), F.struct("det", "step", "start")).alias("best")).select(
        "g", "best.*")


def judge(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, the statistics, ``base_failed, kept, d2`` (and ``row``)."""
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("_lang"),
                                   F.col("source").alias("_source"), F.col("text"), *keep)).drop("text")
    rows = written(_vectors(stats), "quality")
    grouped = _grouped(rows)
    good = written(grouped.where(~F.col("base_failed") & F.col("g").isNotNull()).select(
        "g", *[f"x{i}" for i in range(P)]), "quality-vectors")
    core = written(_core_estimates(good), "quality-core")
    inner = _distances(good, core).where(F.col("d2") <= CHI2_WEIGHT)
    final = written(_moments(inner, ["g"], 1.0), "quality-estimates")
    judged = _distances(grouped, final, "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2",
        *(["row"] if carry else []))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return judge(docs, carry=True).where("kept").select("row.*")
