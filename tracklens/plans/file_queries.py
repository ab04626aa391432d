"""File, record and sink queries. Files are the given tables' own or written from them."""

import os
import uuid
import zipfile

from pyspark.sql import functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.functions import hashing as H
from tracklens.operators import features as ft, targets as tg, ticks as tk
from tracklens.plans import sql as S
from tracklens.plans.ledger_queries import RULE
from tracklens.operators import ledgers as L
from tracklens.operators.ordered import blocked_lag
from tracklens.session import shared_folder, stage_table
from tracklens.sources import rawfiles as R, sinks
from tracklens.sources.tables import event_raw_text, event_reports, lineitem_rows, load

QUERIES: dict = {}
ORACLE: dict = {}


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _local(path):
    return path.removeprefix("file://").removeprefix("file:")


def src_01_file_inventory(spark, folder):
    files = R.inventory(R.file_contents(spark, {"AP1": folder}).filter("path LIKE '%.parquet'"))
    return files.select("airport_id", "relative_path", "filename", "extension", "size_bytes", "audit_type")


QUERIES["src_01_file_inventory"] = src_01_file_inventory


def src_02_file_hashes(spark, folder):
    return R.inventory(R.file_contents(spark, {"AP1": folder})).select("relative_path", "size_bytes", "sha256", "crc32")


QUERIES["src_02_file_hashes"] = src_02_file_hashes


CSV_ROWS = 250_000


def _csv_folder(spark, folder):
    """The raw-text events as CSV files of `CSV_ROWS` at most, so neither the task that writes a file nor one that reads it grows with the table."""
    path = _fresh(spark, "raw")
    raw = event_raw_text(spark, folder)
    lane = F.pmod(F.xxhash64("event_id"), F.lit(max(4, -(-raw.count() // CSV_ROWS))))
    raw.repartition("source_file_id", lane).select(*[F.col(c) for c in ("ID", "Time", "Date", "Altitude", "Speed", "Heading", "Lat", "Lon", "Age", "Range", "Bearing", "Tail", "AltisGNSS")]).write.option("header", True).option("maxRecordsPerFile", CSV_ROWS).csv(path)
    return path


def src_03_csv_audit(spark, folder):
    audit = R.audit_csv(R.file_contents(spark, {"AP1": _csv_folder(spark, folder)}))
    return audit.agg(F.count(F.lit(1)).alias("files"), F.sum("data_row_count").alias("data_rows"), F.count_if("strict_parse_ok").alias("strict_ok"), F.sum("column_mismatch_count").alias("mismatches"),
                     F.count_if("terminal_truncation_candidate").alias("truncated")).select("data_rows", "mismatches", "truncated")


QUERIES["src_03_csv_audit"] = src_03_csv_audit
ORACLE["src_03_csv_audit"] = "SELECT count(*) AS data_rows, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS truncated FROM events"


def src_04_tolerant_read(spark, folder):
    """Permissive CSV read of the same files: malformed rows are kept aside, not lost."""
    from tracklens import constants as K

    schema = ", ".join(f"{c} string" for c in K.RAW_HEADER_V2) + ", corrupt string"
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(_csv_folder(spark, folder))
    return stage_table(rows, "tolerant").agg(F.count(F.lit(1)).alias("n_rows"), F.count("corrupt").alias("corrupt_rows"), F.count_distinct("ID").alias("ids"))


QUERIES["src_04_tolerant_read"] = src_04_tolerant_read
ORACLE["src_04_tolerant_read"] = "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS corrupt_rows, count(DISTINCT CASE WHEN event_id % 101 = 0 THEN -1 ELSE user_id END) AS ids FROM events"


def write_archives(rows, path, header):
    """One archive per partition with one CSV member; written aside and renamed, so retries are harmless."""
    target = _local(path)
    os.makedirs(target, exist_ok=True)

    def write(batches):
        import pandas as pd

        name, count = uuid.uuid4().hex, 0
        aside = os.path.join(target, f".{name}")
        with zipfile.ZipFile(aside, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("log.csv", "w") as member:
            member.write((",".join(header) + "\n").encode())
            for batch in batches:
                count += len(batch)
                member.write(batch[list(header)].to_csv(index=False, header=False).encode())
        os.replace(aside, os.path.join(target, f"{name}.zip"))
        yield pd.DataFrame({"archive": [f"{name}.zip"], "n": [count]})

    return rows.mapInPandas(write, "archive string, n long")


def _archives(spark, folder):
    path = _fresh(spark, "zip")
    rows = load(spark, folder, "events").select("event_id", "user_id", "event_type").repartition(4)
    stage_table(write_archives(rows, path, ("event_id", "user_id", "event_type")), "archives").count()
    return path


def src_05_zip_audit(spark, folder):
    audit = R.audit_zip(R.file_contents(spark, {"AP1": _archives(spark, folder)}))
    return audit.agg(F.count_distinct("relative_path").alias("archives"), F.count("member_path").alias("members"), F.count_if("zip_valid").alias("valid"))


QUERIES["src_05_zip_audit"] = src_05_zip_audit


def src_08_zip_records(spark, folder):
    records = R.read_records(spark, _local(_archives(spark, folder)))
    return records.select(F.element_at("tokens", 1).cast("long").alias("event_id"), F.element_at("tokens", 2).cast("long").alias("user_id"), F.element_at("tokens", 3).alias("event_type"))


QUERIES["src_08_zip_records"] = src_08_zip_records
ORACLE["src_08_zip_records"] = "SELECT event_id, user_id, event_type FROM events"


def _document_lines(spark, folder):
    """Every document is a source file: its first line is the header, the rest are rows."""
    docs = load(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return docs.filter("line > 0").select(
        F.col("doc_id").cast("string").alias("source"), (F.col("line") - 1).cast("long").alias("line"), F.expr("cast(line as long) div 512").alias("piece"), F.split("body", ",").alias("tokens"), "body"
    )


_LINES = """dl AS (SELECT CAST(doc_id AS VARCHAR) AS source, doc_id, unnest(string_split(text, chr(10))[2:]) AS body, generate_subscripts(string_split(text, chr(10))[2:], 1) - 1 AS line FROM documents),
 kept AS (SELECT *, line + 2 AS source_row_number, row_number() OVER (PARTITION BY source ORDER BY line) - 1 AS ordinal, count(*) OVER (PARTITION BY source) AS n FROM dl WHERE NOT regexp_full_match(body, '[, ]*'))"""


def src_09_logical_records(spark, folder):
    lines = _document_lines(spark, folder)
    dispositions = load(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("source"), F.when(F.col("n_chars") % 3 == 0, R.DROP_TERMINAL).otherwise("include").alias("disposition"))
    rows = R.logical_records(lines, dispositions, ("source",), "piece", ("piece", "line"))
    return rows.select("source", "source_row_number", "logical_record_ordinal", F.length("body").cast("long").alias("length"))


QUERIES["src_09_logical_records"] = src_09_logical_records
ORACLE["src_09_logical_records"] = f"""WITH {_LINES} SELECT k.source, source_row_number, ordinal AS logical_record_ordinal, length(body) AS length FROM kept k JOIN documents d ON d.doc_id = k.doc_id WHERE NOT (d.n_chars % 3 = 0 AND ordinal = n - 1)"""


def src_11_row_identity(spark, folder):
    rows = R.logical_records(_document_lines(spark, folder), None, ("source",), "piece", ("piece", "line"))
    return R.with_row_identity(rows, "source", "logical_record_ordinal").select("source", "logical_record_ordinal", "raw_row_id")


QUERIES["src_11_row_identity"] = src_11_row_identity
ORACLE["src_11_row_identity"] = f"""WITH {_LINES} SELECT source, ordinal AS logical_record_ordinal, sha256(concat('{{"ordinal":', ordinal, ',"source":"', source, '"}}')) AS raw_row_id FROM kept"""


def src_12_selected_records(spark, folder):
    """Records named by a list of (source, ordinal), here one per order line."""
    rows = R.logical_records(_document_lines(spark, folder), None, ("source",), "piece", ("piece", "line"))
    wanted = load(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), (F.col("l_linenumber") - 1).cast("long").alias("logical_record_ordinal"))
    return rows.join(wanted, ["source", "logical_record_ordinal"], "left_semi").select("source", "logical_record_ordinal", "source_row_number")


QUERIES["src_12_selected_records"] = src_12_selected_records
ORACLE["src_12_selected_records"] = f"""WITH {_LINES} SELECT source, ordinal AS logical_record_ordinal, source_row_number FROM kept WHERE (doc_id, ordinal) IN (SELECT l_orderkey, l_linenumber - 1 FROM lineitem)"""


def src_10_verify_sources(spark, folder):
    """Manifest with one altered digest and one absent file against the recomputed hashes.

    A table is one file or a folder of part files; its first file by path is the one that is altered or copied.
    """
    seen = R.inventory(R.file_contents(spark, {"AP1": folder}))

    def first(table: str):
        path = F.col("relative_path")
        return seen.filter((path == f"{table}.parquet") | path.startswith(f"{table}.parquet/")).orderBy("relative_path").limit(1)

    chosen = first("orders").select("airport_id", "relative_path", F.lit("0" * 64).alias("changed"))
    altered = seen.join(chosen, ["airport_id", "relative_path"], "left").withColumn("sha256", F.coalesce("changed", "sha256")).select(*seen.columns)
    absent = first("part").withColumn("relative_path", F.lit("gone.csv"))
    return R.verify_sources(altered.unionByName(absent), seen)


QUERIES["src_10_verify_sources"] = src_10_verify_sources
ORACLE["src_10_verify_sources"] = "SELECT 'ap1' AS airport_id, 'orders.parquet' AS relative_path, 'sha256' AS problem FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'ap1', 'gone.csv', 'missing' FROM (SELECT count(*) FROM part)"


def src_07_manifest_sink(spark, folder):
    from tracklens.sources.tables import file_manifest

    path = _fresh(spark, "manifest")
    sinks.write_manifest(file_manifest(spark, folder).drop("k", "stem"), path)
    back = spark.read.parquet(f"{path}/parquet")
    return back.groupBy("airport_id", "header").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


QUERIES["src_07_manifest_sink"] = src_07_manifest_sink
ORACLE["src_07_manifest_sink"] = """SELECT concat('ap', o_custkey % 2) AS airport_id, CASE WHEN o_custkey % 3 = 0 THEN '["ID","Time","Date"]' ELSE '["ID","Time","Date","AltisGNSS"]' END AS header, count(*) AS n,
 CAST(sum(CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_orderkey * 7919 % 100000 END) AS BIGINT) AS bytes FROM orders GROUP BY ALL"""


def snk_01_parquet_ledger(spark, folder):
    """Unique reports written as a sorted, partitioned ledger and read back with a partition filter."""
    unique = L.unique_reports(lineitem_rows(spark, folder), RULE).withColumns({
        "airport_id": F.concat(F.lit("AP"), (F.col("k1") % 2).cast("string")), "partition_year": (F.lit(2000) + F.col("k1") % 3).cast("int"), "partition_month": (F.col("k1") % 12 + 1).cast("int")})
    path = _fresh(spark, "ledger")
    sinks.write_ledger(unique, path, ["airport_id", "k1", "k2"])
    back = spark.read.parquet(path).filter("partition_year = 2001")
    return back.groupBy("airport_id", F.col("partition_month").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("group_size").alias("n_rows"))


QUERIES["snk_01_parquet_ledger"] = snk_01_parquet_ledger
ORACLE["snk_01_parquet_ledger"] = """WITH g AS (SELECT l_orderkey AS k1, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT concat('AP', k1 % 2) AS airport_id, k1 % 12 + 1 AS month, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_rows FROM g WHERE k1 % 3 = 1 GROUP BY ALL"""


def snk_02_sort_contract(spark, folder):
    """Rows out of contract order inside any written file: none."""
    unique = L.unique_reports(lineitem_rows(spark, folder), RULE).withColumns({
        "airport_id": F.concat(F.lit("AP"), (F.col("k1") % 2).cast("string")), "partition_year": (F.lit(2000) + F.col("k1") % 3).cast("int"), "partition_month": (F.col("k1") % 2 + 1).cast("int")})
    path = _fresh(spark, "sorted")
    sinks.write_ledger(unique, path, ["airport_id", "k1", "k2"])
    back = spark.read.parquet(path).select("k1", "k2", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    blocked = back.withColumn("block", F.floor(F.col("i") / 65_536))
    bad = blocked_lag(blocked, ["file"], "block", ["i"], ["k1", "k2"]).filter("prev.k1 > k1 OR (prev.k1 = k1 AND prev.k2 > k2)")
    return bad.agg(F.count(F.lit(1)).alias("out_of_order"))


QUERIES["snk_02_sort_contract"] = snk_02_sort_contract
ORACLE["snk_02_sort_contract"] = "SELECT CAST(0 AS BIGINT) AS out_of_order FROM (SELECT count(*) FROM lineitem)"


def _documents(spark, folder):
    ticks = stage_table(tk.carry_forward(event_reports(spark, folder), CFG), "ticks")
    return sinks.scene_documents(ticks, ft.scene_aircraft(ticks, CFG), tg.scene_targets(ticks, CFG, separations=False), CFG)


def snk_03_scene_documents(spark, folder):
    """Nested scenes written as JSON lines, read back with their schema and flattened again."""
    documents = _documents(spark, folder)
    path = _fresh(spark, "scenes")
    sinks.write_scenes(documents, path)
    back = sinks.read_scenes(spark, path, documents.schema)
    return back.select("scene_id", F.size("source_file_ids").cast("long").alias("n_sources"), F.size(F.flatten("history")).cast("long").alias("n_reports"),
                       F.element_at("targets", F.lit("120"))["onset_events"].alias("onset_120"))


QUERIES["snk_03_scene_documents"] = snk_03_scene_documents
ORACLE["snk_03_scene_documents"] = f"""WITH {S.TARGETS}, cur AS (SELECT t.* FROM ticks t JOIN scenes s ON s.source_day = t.source_day AND s.c = t.k QUALIFY row_number() OVER (PARTITION BY t.source_day, t.k ORDER BY t.aircraft_id) <= 100),
 h AS (SELECT c.source_day, c.k, count(*) AS n_reports, count(DISTINCT x.source_file_id) AS n_sources FROM cur c JOIN ticks x ON x.source_day = c.source_day AND x.aircraft_id = c.aircraft_id AND x.k BETWEEN c.k - 11 AND c.k GROUP BY ALL)
SELECT concat_ws('|', t.airport_id, t.source_day, t.cutoff_us) AS scene_id, h.n_sources, h.n_reports, CAST(t.onset_events AS BIGINT) AS onset_120 FROM targets t JOIN h ON h.source_day = t.source_day AND h.k = t.k WHERE t.horizon_s = 120"""


def src_15_scene_read(spark, folder):
    """Scenes read from JSON lines give back the current aircraft of every cutoff."""
    documents = _documents(spark, folder)
    path = _fresh(spark, "scenes")
    sinks.write_scenes(documents, path)
    back = sinks.read_scenes(spark, path, documents.schema)
    current = back.select("source_day", "cutoff_us", F.explode(F.element_at("history", -1)).alias("r"))
    return current.groupBy("source_day").agg(F.count(F.lit(1)).alias("current_reports"), F.count_distinct("r.aircraft_id").alias("aircraft"), F.max(F.col("cutoff_us") - F.col("r.timestamp_us")).alias("oldest_us"))


QUERIES["src_15_scene_read"] = src_15_scene_read
ORACLE["src_15_scene_read"] = f"""WITH {S.TICKS}{S.SCENES}, cur AS (SELECT t.* FROM ticks t JOIN scenes s ON s.source_day = t.source_day AND s.c = t.k)
SELECT source_day, count(*) AS current_reports, count(DISTINCT aircraft_id) AS aircraft, max(t - timestamp_us) AS oldest_us FROM cur GROUP BY source_day"""


def agg_22_census(spark, folder):
    """Ledger totals by airport and month, one column per classification."""
    unique = L.unique_reports(lineitem_rows(spark, folder), RULE).withColumn("month", F.col("k1") % 12)
    kinds = ["singleton", "identical", "metadata_conflict", "core_state_conflict", "core_and_metadata_conflict"]
    return unique.groupBy("month").pivot("duplicate_classification", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


QUERIES["agg_22_census"] = agg_22_census
from tracklens.plans.ledger_queries import RANKED  # noqa: E402

ORACLE["agg_22_census"] = f"""WITH {RANKED} SELECT k1 % 12 AS month, {', '.join(f"count(*) FILTER (WHERE duplicate_classification = '{k}') AS {k}" for k in ('singleton', 'identical', 'metadata_conflict', 'core_state_conflict', 'core_and_metadata_conflict'))} FROM uniq GROUP BY 1"""
