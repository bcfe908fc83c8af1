"""CSV sources and the end-to-end table job."""

import json
import os
import tempfile

from veilspark.config import VeilConfig
from veilspark.functions.patterns import PatternRegistry
from veilspark.plans.table_job import csv_job, process_csv
from veilspark.session import ensure_checkpoint_dir, materialize, scratch
from veilspark.sources.csv import read_csv, read_csv_batch, read_csv_indexed, with_file_row_index
from veilspark.sources.sinks import write_masked_csv
from veilspark.sources.tables import ADDRESS_PATTERN

CSV = ("name,email,phone,notes\nMara Lind,mara@kiln.test,219-555-0173,glaze NA\n"
       "Tove Berg,tove@kiln.test,219-555-0188,\"said \"\"hi\"\", left\"\nUlf,,,SSN 321-54-9876\n")


def _tmp():
    return tempfile.mkdtemp(prefix="veil-csv-")


def test_encoding_fallback(spark):
    d = _tmp()
    p = os.path.join(d, "latin.csv")
    with open(p, "wb") as f:
        f.write("name,email\nZoë Müller,zoe@kiln.test\nInês,ines@kiln.test\n".encode("latin-1"))
    df, enc = read_csv(spark, p)
    assert enc == "ISO-8859-1"
    assert sorted(r.name for r in df.collect()) == ["Inês", "Zoë Müller"]
    p2 = os.path.join(d, "utf.csv")
    with open(p2, "w", encoding="utf-8") as f:
        f.write("name,email\nZoë Müller,zoe@kiln.test\n")
    assert read_csv(spark, p2)[1] == "UTF-8"


def test_row_index_in_file_order_across_splits(spark):
    d = _tmp()
    p = os.path.join(d, "big.csv")
    with open(p, "w") as f:
        f.write("id,text\n")
        for i in range(5000):
            f.write(f"{i},row {i} padding padding padding padding\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.option("header", True).csv(p)
        assert df.rdd.getNumPartitions() > 3
        rows = with_file_row_index(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_index, int(r.id)) for r in rows) == [(i, i) for i in range(5000)]


def test_batch_isolates_errors(spark):
    d = _tmp()
    good = os.path.join(d, "good.csv")
    with open(good, "w") as f:
        f.write(CSV)
    res = read_csv_batch(spark, [good, os.path.join(d, "missing.csv")])
    assert list(res.tables) == ["good"]
    errs = res.errors.collect()
    assert len(errs) == 1 and errs[0].dataset == "missing"


def test_size_limit(spark):
    d = _tmp()
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write(CSV)
    try:
        read_csv(spark, p, max_size_mb=0.00001)
        raise AssertionError("expected a size error")
    except ValueError as e:
        assert "too large" in str(e)


def test_process_csv_end_to_end(spark):
    d = _tmp()
    p = os.path.join(d, "people.csv")
    with open(p, "w") as f:
        f.write(CSV)
    cfg = VeilConfig(registry=PatternRegistry.default().with_patterns([ADDRESS_PATTERN]))
    out = os.path.join(d, "out")
    res = process_csv(spark, p, out, cfg, timestamp="2024-01-01T00:00:00")
    back, _ = read_csv(spark, os.path.join(out, "masked"))
    masked = {r.name: r for r in back.collect()}
    assert back.columns == ["name", "email", "phone", "notes"]
    assert masked["Mara Lind"].email == "[EMAIL_ADDRESS_REDACTED]" and masked["Mara Lind"].notes == "glaze NA"
    assert masked["Ulf"].notes == "SSN [SOCIAL_SECURITY_NUMBER_REDACTED]" and masked["Ulf"].email == ""
    assert masked["Tove Berg"].notes == 'said "hi", left'
    rep = json.loads(spark.read.text(os.path.join(out, "report")).first().value)
    assert rep["summary"]["total_entities"] == 5
    assert rep["timestamp"] == "2024-01-01T00:00:00"
    law = json.loads(spark.read.text(os.path.join(out, "compliance")).first().value)
    assert law["total_pii_entities"] == 5 and law["timestamp"] == rep["timestamp"]
    assert law["recommendations"] == rep["compliance"]["recommendations"].split(" | ")
    high = spark.read.json(os.path.join(out, "high_risk"))
    by_type = {r.pii_type: r["count"] for r in high.groupBy("pii_type").count().collect()}
    assert by_type == {r["pii_type"]: r["count"] for r in law["high_risk_by_type"]}
    assert {f"pii_type={t}" for t in by_type} == {f for f in os.listdir(os.path.join(out, "high_risk")) if f.startswith("pii")}
    assert res.summary().first().total_entities == 5


def test_csv_job_leaves_no_tables_behind(spark):
    d = _tmp()
    p = os.path.join(d, "people.csv")
    with open(p, "w") as f:
        f.write(CSV)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    kept = materialize(spark.range(3), "kept")
    report = csv_job(spark, p, os.path.join(d, "out"), timestamp="t")
    assert report.timestamp == "t" and report.summary.total_entities > 0
    assert spark.read.json(os.path.join(d, "out", "entities")).count() == report.summary.total_entities
    assert {n for n in set(os.listdir(folder)) - before if n.startswith("veil-")} == {
        n for n in os.listdir(folder) if n.startswith("veil-kept-") and n not in before}
    assert kept.count() == 3


def test_scratch_blocks_nest_and_clean_up_after_errors(spark):
    with scratch(spark) as outer:
        first = materialize(spark.range(2), "outer")
        try:
            with scratch(spark) as inner:
                materialize(spark.range(2), "inner")
                raise RuntimeError("lost")
        except RuntimeError:
            pass
        assert len(inner) == 1 and not os.path.exists(inner[0].removeprefix("file:"))
        assert first.count() == 2 and len(outer) == 1
    assert not os.path.exists(outer[0].removeprefix("file:"))


def test_encoding_is_decided_per_file(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write("name,note\nZoë,keeps \ufffd\n".encode())
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("name,note\nInês,x\n".encode("latin-1"))
    df, enc = read_csv(spark, d)
    assert sorted(tuple(r) for r in df.collect()) == [("Inês", "x"), ("Zoë", "keeps \ufffd")]
    assert enc == "UTF-8, ISO-8859-1"


def test_written_cells_read_back_equal(spark):
    rows = [("  padded  ", 'he said "hi", ok'), ("", "a,b"), ("back\\slash", "'"), ('"', "NA"), ("tab\there", "é")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = os.path.join(_tmp(), "t")
    write_masked_csv(df, out)
    assert sorted(tuple(r) for r in read_csv(spark, out)[0].collect()) == sorted(rows)


def test_row_numbers_are_unique_over_files_and_bad_rows_are_reported(spark):
    d = _tmp()
    for name, rows in (("a", 3), ("b", 2)):
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write("id,text\n" + "".join(f"{name}{i},t\n" for i in range(rows)))
    got = read_csv_indexed(spark, d).collect()
    assert sorted((r.row_index, r.id) for r in got) == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b0"), (4, "b1")]
    wide = os.path.join(_tmp(), "wide.csv")
    with open(wide, "w") as f:
        f.write("name,email\nA,a@kiln.test,219-555-0173\nB,\n")
    res = read_csv_batch(spark, [wide])
    assert sorted(tuple(r) for r in res.tables["wide"].select("name", "email").collect()) == [("A", "a@kiln.test"), ("B", "")]
    bad = res.errors.collect()
    assert [(r.dataset, r.record) for r in bad] == [("wide", "A,a@kiln.test,219-555-0173")]
    out = os.path.join(_tmp(), "out")
    process_csv(spark, wide, out, timestamp="t")
    errors = spark.read.json(os.path.join(out, "errors")).collect()
    assert len(errors) == 1 and "0173" not in errors[0]["_bad_record"]


def _write(d, name, data: bytes):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data)


def test_own_columns_named_like_internal_ones(spark):
    d = _tmp()
    _write(d, "t.csv", b"row_index,e.mail,_bad_record,f0,file,a`b\n7,a@b.io,x,y,z,555-222-3333\n8,,,,\n")
    p = os.path.join(d, "t.csv")
    got = read_csv_indexed(spark, p)
    assert got.columns == ["row_index_", "row_index", "e.mail", "_bad_record", "f0", "file", "a`b", "_bad_record_"]
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [(0, "7", "a@b.io"), (1, "8", "")]
    out = os.path.join(d, "out")
    res = process_csv(spark, p, out, timestamp="t")
    assert {(r.row_index, r.column_name, r.pii_type) for r in res.entities.collect()} == {
        (0, "e.mail", "email_address"), (0, "a`b", "phone_number")}
    back, _ = read_csv(spark, os.path.join(out, "masked"))
    assert back.columns == ["row_index", "e.mail", "_bad_record", "f0", "file", "a`b"]
    assert sorted(r[1] for r in back.collect()) == ["", "[EMAIL_ADDRESS_REDACTED]"]


def test_batch_groups_files_by_header_and_isolates_broken_ones(spark):
    import gzip

    d = _tmp()
    for i in range(12):
        _write(d, f"a{i:02d}.csv", "".join(["name,email\n", *[f"N{i}-{k},u{k}@b.io\n" for k in range(i)]]).encode())
        _write(d, f"b {i:02d}.csv", f"id,note\n{i},Inês {i}\n".encode("latin-1" if i % 2 else "utf-8"))
    whole = gzip.compress(b"name,email\n" + b"".join(b"Row %d,x%d@b.io\n" % (k, k * 7919) for k in range(20000)))
    _write(d, "whole.csv.gz", whole)
    _write(d, "half.csv.gz", whole[:len(whole) // 2])
    _write(d, "empty.csv", b"")
    paths = [os.path.join(d, n) for n in sorted(os.listdir(d))] + [os.path.join(d, "missing.csv")]
    res = read_csv_batch(spark, paths)
    assert set(res.tables) == {f"a{i:02d}" for i in range(12)} | {f"b {i:02d}" for i in range(12)} | {"whole.csv", "empty"}
    assert {r.dataset for r in res.errors.collect()} == {"half.csv", "missing"}
    by_columns = {tuple(g.columns[3:-1]): g for g in res.groups}
    assert set(by_columns) == {("name", "email"), ("id", "note"), ()}
    rows = by_columns[("name", "email")].collect()
    assert len(rows) == sum(range(12)) + 20000
    numbers = {}
    for r in rows:
        numbers.setdefault(r.dataset, set()).add(r.row_index)
    assert all(n == set(range(len(n))) for n in numbers.values()) and len(numbers["a11"]) == 11
    assert sorted(r.note for r in by_columns[("id", "note")].collect()) == sorted(f"Inês {i}" for i in range(12))
    assert sorted(tuple(r) for r in res.tables["a03"].collect()) == [(k, f"N3-{k}", f"u{k}@b.io") for k in range(3)]
    assert res.tables["empty"].count() == 0
