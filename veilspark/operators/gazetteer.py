"""Gazetteer detector: the model-free stand-in for named-entity recognition.

Texts are cut into word tokens with offsets.  The n-grams of every length that
some phrase of the gazetteer has are looked up in a Bloom filter as they leave
their cell; only those that pass are joined to the ``(phrase, label)`` rows, so
what is shuffled follows the hits, not the tokens.  A very common phrase is one skewed join key with a
single gazetteer row, which adaptive execution splits.  Labels go through the NER label map (unmapped labels are dropped).  Whether
the gazetteer is broadcast is the planner's choice, by its measured size.
Matches become 0.8-confidence ``ner`` spans that join the regex spans in
overlap resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.patterns import NER_LABELS, PatternSpec

TOKEN_PATTERN = PatternSpec("token", r"[\p{L}\p{N}_#]+")


def label_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NER_LABELS, "label string, pii_type string")


def map_labels(matches: DataFrame) -> DataFrame:
    """Label -> PII type; labels without a type (DATE, CARDINAL, ...) drop out."""
    return matches.join(F.broadcast(label_map(matches.sparkSession)), "label")


#: bits of the Bloom filter: some for each entry, and a fixed most (16 MB as one value)
BITS_PER_ENTRY, MOST_BITS, HASHES = 12, 1 << 27, 2


def _places(value: str, bits: int) -> list[str]:
    return [f"pmod(xxhash64({value}, {k}), {bits}L)" for k in range(HASHES)]


def key_filter(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """One row ``words`` and the number of bits: a Bloom filter of a column's values.

    Its size follows the number of rows up to ``MOST_BITS``; beyond that
    it lets more through, and the join still decides."""
    n = keys.count()
    bits = 1 << 10
    while bits < min(MOST_BITS, n * BITS_PER_ENTRY):
        bits *= 2
    places = keys.select(F.expr(f"explode(array({', '.join(_places(column, bits))}))").alias("bit"))
    words = places.groupBy(F.expr("CAST(bit div 64 AS INT)").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("v"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("v"))
    return words.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words")), bits


def passes(rows: DataFrame, column: str, held: DataFrame, bits: int) -> DataFrame:
    """The rows whose value the filter may hold.

    The filter stands in the condition as a scalar subquery, one value a task:
    as a column it would be copied into every row."""
    words = held.select("words").scalar()
    for place in _places(column, bits):
        word = F.get(words, F.expr(f"CAST({place} div 64 AS INT)"))
        rows = rows.where(F.getbit(word, F.expr(f"CAST({place} % 64 AS INT)")) == 1)
    return rows


def phrase_filter(gazetteer: DataFrame) -> tuple[DataFrame, int]:
    """One row ``lengths, words`` and the number of bits: the phrases' numbers of
    tokens, and the words of a Bloom filter of the phrases."""
    tokens = F.expr(f"regexp_extract_all(phrase, {S.sql_str(TOKEN_PATTERN.java())}, 0)")
    phrases = gazetteer.select("phrase", F.size(tokens).alias("tokens")).where("tokens > 0")
    filled, bits = key_filter(phrases, "phrase")
    lengths = phrases.agg(F.array_sort(F.collect_set("tokens")).alias("lengths"))
    return filled.select("words", lengths.scalar().alias("lengths")), bits


def _all_ngrams(cells: DataFrame, lengths: Column) -> DataFrame:
    """``row_index, column_ordinal, column_name, start, end, phrase`` of every n-gram of the given lengths."""
    from .detect import bind_column

    toks = S.pattern_spans(F.col("cell_text"), TOKEN_PATTERN, 0)
    with_toks = bind_column(cells.select("row_index", "column_ordinal", "column_name", "cell_text"), "toks", toks)
    # a token with the text before it: an n-gram is put together without a scan from the text's start
    gaps = f"slice(split(cell_text, {S.sql_str(TOKEN_PATTERN.java())}, -1), 1, size(toks))"
    pieces = bind_column(with_toks.where(F.size("toks") > 0), "pieces", F.expr(f"zip_with({gaps}, toks, (g, t) -> concat(g, t.text))"))
    of_length = pieces.select("row_index", "column_ordinal", "column_name", "toks", "pieces", F.explode(lengths).alias("n"))
    grams = ("transform(sequence(0, size(toks) - n), i -> named_struct('start', toks[i].start, 'end', toks[i + n - 1].end, "
             "'phrase', concat(toks[i].text, array_join(slice(pieces, i + 2, n - 1), ''))))")
    return of_length.where("n <= size(toks)").select("row_index", "column_ordinal", "column_name", F.inline_outer(F.expr(grams)))


def ngrams(cells: DataFrame, gazetteer: DataFrame, capitalised: bool = False) -> DataFrame:
    """``row_index, column_ordinal, column_name, start, end, phrase`` for every n-gram that
    passes the gazetteer's filter (``capitalised``: only those that start in upper case)."""
    held, bits = phrase_filter(gazetteer)
    found = passes(_all_ngrams(cells, held.select("lengths").scalar()), "phrase", held, bits)
    return found.where(F.col("phrase").rlike(r"^\p{Lu}")) if capitalised else found


def gazetteer_matches(cells: DataFrame, gazetteer: DataFrame, capitalised: bool = False) -> DataFrame:
    """Raw gazetteer hits with their NER label (before the label map)."""
    gz = gazetteer.select("phrase", "label").dropDuplicates(["phrase", "label"])
    return ngrams(cells, gz, capitalised).join(gz, "phrase")


def gazetteer_spans(cells: DataFrame, gazetteer: DataFrame, capitalised: bool = False, longest: bool = False) -> DataFrame:
    """``row_index, column_ordinal, column_name, start, end, text, pii_type`` of mapped hits
    (``longest``: of the hits that begin at one place only the longest)."""
    m = map_labels(gazetteer_matches(cells, gazetteer, capitalised))
    if longest:
        place = Window.partitionBy("row_index", "column_ordinal", "start")
        m = m.withColumn("_most", F.max("end").over(place)).where("end = _most").drop("_most")
    return m.select("row_index", "column_ordinal", "column_name", "start", "end", F.col("phrase").alias("text"),
                    "pii_type")


def spans_per_cell(cells: DataFrame, spans: DataFrame, prio_base: int) -> DataFrame:
    """Attach the gazetteer spans of each cell as an ``extra`` array column."""
    from .detect import attach_spans

    return attach_spans(cells, spans, prio_base)
