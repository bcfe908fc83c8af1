"""CSV sources: all-string tables with a per-file encoding, row numbers in file
order, bad records kept aside, size guard and per-file error isolation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cells import named
from ..session import materialize

#: column that holds the raw line of a row that does not fit the header
BAD_RECORD = "_bad_record"
#: names inside a scan, where the file's own columns are numbered
_BAD, _FILE, _BLOCK, _ORDER = "bad", "file", "block", "mid"


def free_name(wanted: str, names: list[str]) -> str:
    """``wanted``, with underscores behind it until none of ``names`` is the same."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


@dataclass
class Scan:
    """Rows of CSV files: fields ``f0, f1, ...``, the raw text of bad rows, and where a row stands."""

    frame: DataFrame
    names: list[str]

    def fields(self) -> list:
        return [F.col(f"f{i}").alias(n) for i, n in enumerate(self.names)]


def _reader(spark: SparkSession, encoding: str, multiline: bool):
    return (
        spark.read.option("header", True).option("encoding", encoding).option("multiLine", multiline)
        .option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def _names(spark: SparkSession, path: str, encoding: str, multiline: bool) -> list[str]:
    return _reader(spark, encoding, multiline).option("inferSchema", False).csv(path).columns


def _read(spark: SparkSession, paths: list[str], encoding: str, multiline: bool, names: list[str] | None = None) -> Scan:
    """Header row, every column a string, text such as "NA" a value, quotes doubled.

    Rows with more or fewer fields than the header carry their raw text in
    ``bad`` (surplus fields are in no column).  ``multiline`` parses
    quoted fields that contain line breaks, but then a file is read by one
    task; without it files split.  With ``names`` no file is opened here.
    """
    names = _names(spark, paths[0], encoding, multiline) if names is None else names
    if not names:
        return Scan(spark.createDataFrame([], f"{_BAD} string, {_FILE} string, {_BLOCK} long, {_ORDER} long"), [])
    own = [f"f{i}" for i in range(len(names))]
    fields = ", ".join(f"{n} STRING" for n in [*own, _BAD])
    df = _reader(spark, encoding, multiline).schema(fields).option("columnNameOfCorruptRecord", _BAD).csv(paths)
    return Scan(df.select(
        # an empty field is an empty string whether or not it was quoted
        *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in own],
        # all fields are named, so that none is pruned from the parser, which could not count them then
        F.when(F.length(F.concat_ws("", *own)) >= 0, F.col(_BAD)).alias(_BAD),
        F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ORDER)), names)


def _undecodable(spark: SparkSession, path: str) -> set[str]:
    """Names of the files that hold bytes which are not UTF-8 (the scan compares raw bytes)."""
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("f")).distinct()
    return {r.f for r in bad.collect()}  # file names only


def total_size_mb(spark: SparkSession, path: str) -> float:
    """Size of the files under ``path`` (file metadata only, contents are not read)."""
    row = spark.read.format("binaryFile").load(path).select(F.sum("length").alias("n")).first()
    return (row["n"] or 0) / (1024 * 1024)


def _scan(spark: SparkSession, path: str, max_size_mb: float | None, encodings: tuple[str, ...],
          multiline: bool) -> tuple[Scan, str]:
    if max_size_mb is not None:
        size = total_size_mb(spark, path)
        if size > max_size_mb:
            raise ValueError(f"File too large: {size:.1f}MB (max: {max_size_mb}MB)")
    first, *other = encodings
    odd = _undecodable(spark, path) if other and first.upper() in ("UTF-8", "UTF8") else set()
    if not odd:
        return _read(spark, [path], first, multiline), first
    files = set(spark.read.text(path).inputFiles())
    odd = {f for f in files if _plain(f) in {_plain(o) for o in odd}}
    rest = _read(spark, sorted(odd), other[0], multiline)
    if odd == files:
        return rest, other[0]
    main = _read(spark, sorted(files - odd), first, multiline)
    return Scan(main.frame.unionByName(rest.frame), main.names), f"{first}, {other[0]}"


def _plain(uri: str) -> str:
    """A file URI without its scheme's slashes, which differ between listings."""
    return uri.split(":", 1)[-1].lstrip("/")


def read_csv(spark: SparkSession, path: str, max_size_mb: float | None = None,
             encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), multiline: bool = False,
             bad_records: bool = False) -> tuple[DataFrame, str]:
    """Read a CSV table (a file or a folder of files with one header); return ``(frame, encoding used)``.

    The encoding is decided per file, on undecodable bytes: files that are
    not valid UTF-8 are read with the next encoding (ISO-8859-1 accepts every
    byte), the others stay UTF-8.  With ``bad_records`` rows that do not fit
    the header keep their raw text in column ``_bad_record``.
    """
    scan, encoding = _scan(spark, path, max_size_mb, encodings, multiline)
    bad = [F.col(_BAD).alias(free_name(BAD_RECORD, scan.names))] if bad_records else []
    return scan.frame.select(*scan.fields(), *bad), encoding


def read_csv_indexed(spark: SparkSession, path: str, max_size_mb: float | None = None,
                     encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), multiline: bool = False,
                     name: str = "row_index") -> DataFrame:
    """``read_csv`` with bad records and a 0-based row number over all files, in path order.

    The row number is the first column and the bad record the last one; where
    the file has a column of that name, underscores follow theirs."""
    scan, _ = _scan(spark, path, max_size_mb, encodings, multiline)
    return _finished(scan, _numbered(scan.frame), name)


def _finished(scan: Scan, numbered: DataFrame, name: str = "row_index") -> DataFrame:
    return numbered.select(F.col("number").alias(free_name(name, scan.names)), *scan.fields(),
                           F.col(_BAD).alias(free_name(BAD_RECORD, scan.names)))


def with_file_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based row number in file order of a frame that is read from files."""
    own = [f"f{i}" for i in range(len(df.columns))]
    scan = Scan(df.select(*[named(c).alias(f) for c, f in zip(df.columns, own)], F.col("_metadata.file_path").alias(_FILE),
                          F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ORDER)), df.columns)
    return _numbered(scan.frame).select(F.col("number").alias(free_name(name, df.columns)), *scan.fields())


def _numbered(rows: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``number``: rows in file order without a global sort (inside each of ``within``).

    Rows keep their order inside a file split; splits are ordered by path
    and byte offset.  Each split gets an offset from a prefix sum over the
    split counts (one row a split), and a row's number is that offset plus its
    position inside the split, so numbers are unique over all files.  The
    offsets are written first: the join then knows their size, and they are
    broadcast unless there are very many splits.
    """
    within = within or []
    splits = rows.groupBy(*within, _FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min(_ORDER).alias("least"))
    w = Window.partitionBy(*within).orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(splits.select(_FILE, _BLOCK, "least", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "splits")
    return rows.join(offsets, [_FILE, _BLOCK]).withColumn("number", F.col("before") + F.col(_ORDER) - F.col("least"))


@dataclass
class BatchRead:
    tables: dict[str, DataFrame]     # data set name -> table with row_index
    errors: DataFrame                # dataset, path, error, record
    groups: list[DataFrame]          # one scan a header: dataset, path, row_index, columns, _bad_record


def _listed(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Files of a path (a file, a folder or a pattern): name as scans report it -> path to read, size."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    left, files = list(fs.globStatus(top) or []), {}
    while left:
        status = left.pop()
        if status.isDirectory():
            left += [x for x in fs.listStatus(status.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        else:
            files[_plain(status.getPath().toUri().toString())] = (status.getPath().toString(), status.getLen())
    return files


def _heads(spark: SparkSession, files: dict[str, str]) -> tuple[dict, dict[str, str]]:
    """First line of each file and whether it is UTF-8, in one job over all files.

    Every file is read to its end here.  When the job fails, the files are
    halved until those that cannot be read stand alone: they come back with
    their error, the others with their first lines.
    """
    lines = spark.read.text(list(files.values())).select(
        "value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ORDER))
    found = lines.groupBy(_FILE).agg(F.min_by("value", F.struct(_BLOCK, _ORDER)).alias("head"),
                                     F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    try:
        return {_plain(r[_FILE]): (r.head, r.utf8) for r in found.collect()}, {}  # one row a file
    except Exception as e:  # noqa: BLE001 - isolate per file
        if len(files) == 1:
            return {}, {name: _reason(e) for name in files}
    names = list(files)
    parts = [_heads(spark, {n: files[n] for n in half}) for half in (names[:len(names) // 2], names[len(names) // 2:])]
    return parts[0][0] | parts[1][0], parts[0][1] | parts[1][1]


def _reason(e: Exception) -> str:
    lines = str(e).splitlines() or [""]
    caused = [line.split("Caused by:", 1)[1].strip() for line in lines if "Caused by:" in line]
    return f"{type(e).__name__}: {(caused[-1] if caused else lines[0])[:500]}"


def read_csv_batch(spark: SparkSession, paths: list[str], max_size_mb: float | None = None,
                   multiline: bool = False, encodings: tuple[str, str] = ("UTF-8", "ISO-8859-1")) -> BatchRead:
    """Open several CSV data sets (files or folders), each with its own header.

    Files with the same header and encoding are one scan, however many they
    are; first lines and encodings of all files come from one job.  A path
    that does not exist, is too large or holds a file that fails while it is
    read becomes a row of ``errors`` instead of failing the batch, and so does
    every row that does not fit its file's header (it stays in the table with
    the fields that fit).  The loops run over file names only.
    """
    schema = "dataset string, path string, error string, record string"
    sets, place, failed = {}, {}, []
    for p in paths:
        name = p.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
        files = _listed(spark, p)
        size = sum(n for _, n in files.values()) / (1024 * 1024)
        if not files:
            failed.append((name, p, f"PathNotFound: no file at {p}", None))
        elif max_size_mb is not None and size > max_size_mb:
            failed.append((name, p, f"ValueError: File too large: {size:.1f}MB (max: {max_size_mb}MB)", None))
        else:
            sets[name] = (p, sorted(files))
            place |= {f: where for f, (where, _) in files.items()}
    heads, why = _heads(spark, place) if place else ({}, {})
    by_head: dict[str, dict] = {}
    for name, (p, files) in sets.items():
        lost = [f for f in files if f in why]
        if lost:
            failed += [(name, place[f], why[f], None) for f in lost]
            continue
        head = next((heads[f][0] for f in files if f in heads), "")
        by_head.setdefault(head, {})[name] = (p, files)
    tables, groups, bad = {}, [], None

    def utf8(file: str) -> bool:
        return heads.get(file, ("", True))[1]

    def scan(files: list[str], names: list[str]) -> Scan:
        kinds = [([place[f] for f in files if utf8(f) == kind], encoding) for kind, encoding in zip((True, False), encodings)]
        scans = [_read(spark, some, encoding, multiline, names) for some, encoding in kinds if some]
        frame = scans[0].frame if len(scans) == 1 else scans[0].frame.unionByName(scans[1].frame)
        return Scan(frame, scans[0].names)

    for members in by_head.values():
        files = [f for _, own in members.values() for f in own]
        names = _names(spark, place[files[0]], encodings[0] if utf8(files[0]) else encodings[1], multiline)
        whole = scan(files, names)
        owner = spark.createDataFrame([(f, name, p) for name, (p, own) in members.items() for f in own],
                                      "plain string, dataset string, path string")
        plain = F.regexp_replace(F.substring_index(_FILE, ":", -1), "^/+", "")
        owned = whole.frame.withColumn("plain", plain).join(owner, "plain")
        numbered = _numbered(owned, ["dataset"])
        clear = [*names]
        keys = [F.col(k).alias(free_name(k, clear)) for k in ("dataset", "path")]
        groups.append(numbered.select(*keys, F.col("number").alias(free_name("row_index", clear)), *whole.fields(),
                                      F.col(_BAD).alias(free_name(BAD_RECORD, clear))))
        unfit = numbered.where(F.col(_BAD).isNotNull()).select(
            "dataset", "path", F.format_string("row %d does not fit the header", "number").alias("error"), F.col(_BAD).alias("record"))
        bad = unfit if bad is None else bad.unionByName(unfit)
        for name in members:
            mine = numbered.where(F.col("dataset") == name)
            tables[name] = _finished(whole, mine).drop(free_name(BAD_RECORD, clear))
    errors = spark.createDataFrame(failed, schema)
    return BatchRead(tables, errors if bad is None else errors.unionByName(bad), groups)
