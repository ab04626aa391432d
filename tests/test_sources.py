"""File sources and sinks on small fixtures."""

import hashlib
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tracklens.sources import rawfiles as R, sinks


@pytest.fixture()
def raw(tmp_path):
    root = tmp_path / "raw"
    day = root / "2021" / "01-02-21"
    day.mkdir(parents=True)
    (day / "good.csv").write_text("ID,Date\na,2021-01-02\nb,01-02-21\n")
    (day / "cut.csv").write_text("ID,Date\na,2021-01-02\nb")
    (day / "quote.csv").write_text('ID,Date\na,"2021')
    (day / "latin.csv").write_bytes(b"ID,Date\n\xff\xfe,2021-01-03\n")
    (day / "blank.csv").write_text("ID,Date\n\na,x\n ,\n")
    (day / "head.csv").write_text("ID,Date\n")
    (day / "empty.csv").write_text("")
    (day / "long.csv").write_text("ID,Date\n" + "".join(f"r{i},x\n" for i in range(12)))
    (day / "note.txt").write_text("hello")
    with zipfile.ZipFile(root / "old.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("01-02-21/good.csv", "ID,Date\na,2021-01-02\n")
        z.writestr("01-02-21/more.csv", 'ID,Date\nq,"[u\'1\', u\'2\']"\nr,2\n')
    (root / "broken.zip").write_bytes(b"PK nothing")
    return root


def test_inventory(spark, raw):
    rows = {r.filename: r for r in R.inventory(R.file_contents(spark, {"AP1": str(raw)})).collect()}
    assert len(rows) == 11
    good = rows["good.csv"]
    body = (raw / "2021/01-02-21/good.csv").read_bytes()
    assert (good.relative_path, good.year, good.date_directory, good.audit_type) == ("2021/01-02-21/good.csv", "2021", "01-02-21", "csv")
    assert good.sha256 == hashlib.sha256(body).hexdigest() and good.crc32 == f"{zlib.crc32(body):08x}" and good.size_bytes == len(body)
    assert rows["old.zip"].audit_type == "zip" and rows["note.txt"].audit_type == "binary"


def test_csv_audit(spark, raw):
    rows = {r.relative_path.rsplit("/", 1)[1]: r for r in R.audit_csv(R.file_contents(spark, {"AP1": str(raw)})).collect()}
    assert (rows["good.csv"].date_status, rows["good.csv"].data_row_count, rows["good.csv"].observed_date_tokens) == ("match", 2, ["01-02-21"])
    assert rows["cut.csv"].terminal_truncation_candidate and rows["cut.csv"].column_mismatch_count == 1
    assert not rows["quote.csv"].strict_parse_ok and rows["quote.csv"].tolerant_parse_ok
    assert rows["latin.csv"].decode_error.startswith("no UTF-8 from byte 8") and not rows["latin.csv"].terminal_truncation_candidate
    assert (rows["blank.csv"].blank_row_count, rows["blank.csv"].date_status) == (2, "no_date_values")
    assert rows["head.csv"].header_only and rows["empty.csv"].is_empty and rows["empty.csv"].strict_parse_ok
    assert rows["long.csv"].last_five == [[f"r{i}", "x"] for i in range(7, 12)] and rows["long.csv"].logical_record_count == 13
    assert rows["cut.csv"].last_five == [["a", "2021-01-02"], ["b"]] and not rows["cut.csv"].last_five_complete


def test_zip_audit(spark, raw):
    rows = R.audit_zip(R.file_contents(spark, {"AP1": str(raw)})).collect()
    members = {r.member_path: r for r in rows if r.member_path}
    assert set(members) == {"01-02-21/good.csv", "01-02-21/more.csv"} and all(r.zip_valid for r in members.values())
    broken = [r for r in rows if r.relative_path == "broken.zip"]
    assert len(broken) == 1 and not broken[0].zip_valid and "BadZipFile" in broken[0].zip_error


def test_verify_sources(spark, raw):
    seen = R.inventory(R.file_contents(spark, {"AP1": str(raw)}))
    assert R.verify_sources(seen, seen).count() == 0
    changed = seen.withColumn("size_bytes", F.when(F.col("filename") == "good.csv", 1).otherwise(F.col("size_bytes")))
    assert [(r.relative_path, r.problem) for r in R.verify_sources(changed, seen).collect()] == [("2021/01-02-21/good.csv", "size")]


@pytest.mark.parametrize("split", [0, 7, 50])
def test_records_with_splits_and_terminal_drop(spark, tmp_path, split):
    root = tmp_path / "csv"
    root.mkdir()
    (root / "a.csv").write_text("ID,Date\n" + "".join(f"x{i},{i}\n" if i % 5 else "\n" for i in range(30)))
    with zipfile.ZipFile(root / "b.zip", "w") as z:
        z.writestr("m.csv", "ID,Date\np,1\n,\nq,2\n")
    records = R.read_records(spark, str(root), split).withColumn("member", F.coalesce("archive_member", F.lit("")))
    dispositions = spark.createDataFrame([("a.csv", "", R.DROP_TERMINAL), ("b.zip", "m.csv", "include")], "relative_path string, member string, disposition string")
    rows = R.logical_records(records, dispositions).collect()
    a = sorted((r.logical_record_ordinal, r.source_row_number, r.tokens[0]) for r in rows if r.relative_path == "a.csv")
    want = [(i + 2, f"x{i}") for i in range(30) if i % 5]
    assert a == [(n, row, token) for n, (row, token) in enumerate(want[:-1])]
    assert sorted((r.source_row_number, r.tokens[0]) for r in rows if r.relative_path == "b.zip") == [(2, "p"), (4, "q")]


def test_manifest_and_ledger_sinks(spark, tmp_path):
    df = spark.createDataFrame([("AP1", 2021, 1, 5, ["x", "y"]), ("AP2", 2022, 3, 4, [])], "airport_id string, partition_year int, partition_month int, v int, names array<string>")
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert {r.names for r in spark.read.parquet(str(tmp_path / "m" / "parquet")).collect()} == {'["x","y"]', "[]"}
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "csv")).columns == sorted(df.columns)
    sinks.write_ledger(df, str(tmp_path / "l"), ["airport_id", "v"])
    assert (tmp_path / "l" / "airport_id=AP1" / "partition_year=2021" / "partition_month=1").is_dir()
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
