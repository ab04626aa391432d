"""Raw CSV files and ZIP archives: inventory, structural audit and logical records."""

import csv
import io
import os
import re
import zipfile
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracklens.functions import text
from tracklens.operators.ordered import blocked_row_number, blocked_running_sum, first_per_group
from tracklens.session import prepare, stage_table

DROP_TERMINAL = "drop_terminal_record"


def file_contents(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Files under each airport root with their bytes, one row per file.

    The scan skips zero-length files, so they are added from its own file index.
    """
    prepare(spark)
    found = []
    for airport, root in sorted(roots.items()):
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        listed = spark.createDataFrame([(unquote(f),) for f in scan.inputFiles()], "listed string")
        path = lambda c: F.regexp_replace(c, "^file:/*", "/")
        full = scan.select(path("path").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"), "content")
        empty = listed.select(path("listed").alias("path")).join(full.select("path"), "path", "left_anti").select(
            "path", F.lit(0).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_time"), F.lit(b"").alias("content")
        )
        found.append(full.unionByName(empty).select(
            F.lit(airport.lower()).alias("airport_id"), "*", F.regexp_replace("path", "^" + re.escape(os.path.abspath(root)) + "/?", "").alias("relative_path")
        ))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def inventory(contents: DataFrame) -> DataFrame:
    """Identity of every file: name parts, date directory, SHA-256 and CRC-32. Bytes stay in the JVM."""
    name = F.element_at(F.split("relative_path", "/"), -1)
    date_part = F.filter(F.split("relative_path", "/"), lambda p: p.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{2}$"))
    year_part = F.filter(F.split("relative_path", "/"), lambda p: p.rlike("^[0-9]{4}$"))
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return contents.select(
        "airport_id", "relative_path", name.alias("filename"), extension.alias("extension"), F.get(year_part, 0).alias("year"),
        text.path_date_token(F.get(date_part, 0)).alias("date_directory"), "size_bytes", "modified_time",
        F.sha2("content", 256).alias("sha256"), F.lower(F.lpad(F.hex(F.crc32("content")), 8, "0")).alias("crc32"),
        F.when(extension == ".csv", "csv").when(extension == ".zip", "zip").otherwise("binary").alias("audit_type"),
    )


FILE = ["airport_id", "relative_path"]
RECORD_BATCH = 4_096
TAIL = 5
RECORD_SCHEMA = "airport_id string, relative_path string, n long, tokens array<string>, parse_error string, decode_error string, tolerant_parse_ok boolean"


def _reader(content: bytes, strict: bool):
    stream = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", errors="strict" if strict else "replace", newline="")
    return csv.reader(stream, strict=strict)


def _readable(content: bytes) -> bool:
    try:
        return sum(1 for _ in _reader(content, False)) >= 0
    except csv.Error:
        return False


def _numbered(content: bytes):
    """Rows of `RECORD_SCHEMA` without the file's name; a file that strict rules reject ends with a row that holds the reason."""
    n = 0
    try:
        for n, tokens in enumerate(_reader(content, True), 1):
            yield n, tokens, None, None, None
    except csv.Error as error:
        yield n + 1, None, str(error), None, _readable(content)
    except UnicodeDecodeError as error:
        yield n + 1, None, None, f"no UTF-8 from byte {error.start} on ({error.reason})", _readable(content)


def csv_records(files: DataFrame) -> DataFrame:
    """One row per record of each CSV file, in batches, up to the record where strict parsing fails."""
    def read(batches):
        import pandas as pd

        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for airport, path, content in zip(batch.airport_id, batch.relative_path, batch.content):
                rows = _numbered(bytes(content))
                while part := list(islice(rows, RECORD_BATCH)):
                    yield pd.DataFrame([(airport, path, *row) for row in part], columns=names)

    return files.select(*FILE, "content").mapInPandas(read, RECORD_SCHEMA)


def truncation_candidate() -> Column:
    """The file stops inside a record: no final line break, and an open or overlong last field or one short row among the last."""
    open_field = F.coalesce(F.lower("parse_error").rlike("unexpected end of data|field larger than field limit"), F.lit(False))
    short_row = F.col("strict_parse_ok") & (F.col("column_mismatch_count") == 1) & ~F.col("last_five_complete")
    return (F.col("data_row_count") > 0) & ~F.col("ends_with_newline") & (open_field | short_row)


def date_status() -> Column:
    """How the dates in a file's Date column agree with the date of its directory."""
    dates, expected = F.col("observed_date_tokens"), F.col("expected_date")
    compared = F.when(dates == F.array(expected), "match").when(F.size(dates) > 0, "mismatch").otherwise("no_date_values")
    return F.when(expected.isNull(), "not_checked").otherwise(F.when(F.array_contains("header", "Date"), compared).otherwise("not_assessable"))


def audit_csv(contents: DataFrame) -> DataFrame:
    """Structural audit of each CSV file: counts, header, dates and last rows are aggregations over its records."""
    files = contents.filter(F.lower("relative_path").endswith(".csv"))
    records = stage_table(csv_records(files), "records").withColumn("filled", F.coalesce(F.exists("tokens", lambda t: t.rlike(r"(?U)\S")), F.lit(False)))
    heads = records.filter("filled").groupBy(*FILE).agg(F.min(F.struct("n", "tokens")).alias("head"))
    rows = records.join(heads, FILE, "left").select(
        *FILE, "n", "tokens", "filled", "parse_error", "decode_error", "tolerant_parse_ok", F.col("head.tokens").alias("header"),
        F.coalesce(F.col("filled") & (F.col("n") > F.col("head.n")), F.lit(False)).alias("is_data"),
    ).withColumn("is_odd", F.col("is_data") & (F.size("tokens") != F.size("header")))
    dated = text.all_date_tokens(F.get("tokens", (F.array_position("header", "Date") - 1).cast("int")))
    counted = rows.groupBy(*FILE).agg(
        F.max("header").alias("header"), F.count("tokens").alias("logical_record_count"), F.count_if("is_data").alias("data_row_count"),
        F.count_if(F.col("tokens").isNotNull() & ~F.col("filled")).alias("blank_row_count"), F.count_if("is_odd").alias("column_mismatch_count"),
        F.max("parse_error").alias("parse_error"), F.max("decode_error").alias("decode_error"), F.max("tolerant_parse_ok").alias("tolerant_parse_ok"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("is_data"), dated))))).alias("observed_date_tokens"),
    )
    data = rows.filter("is_data").select(*FILE, "n", "tokens", "is_odd", (-F.col("n")).alias("back"))
    tails = first_per_group(data, FILE, ["back"], TAIL).groupBy(*FILE).agg(
        F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("tail"), (~F.bool_or("is_odd")).alias("last_five_complete"),
    )
    shape = files.select(*FILE, (F.length("content") == 0).alias("is_empty"), F.hex(F.substring("content", -1, 1)).isin("0A", "0D").alias("ends_with_newline"))
    strict = F.col("parse_error").isNull() & F.col("decode_error").isNull()
    date_part = F.get(F.filter(F.split("relative_path", "/"), lambda p: p.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{2}$")), 0)
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    none = F.array().cast("array<string>")
    audited = shape.join(counted, FILE, "left").join(tails, FILE, "left").select(
        *FILE, "is_empty", (strict & F.col("header").isNotNull() & (F.col("data_row_count") == 0)).alias("header_only"),
        strict.alias("strict_parse_ok"), F.coalesce("tolerant_parse_ok", F.lit(True)).alias("tolerant_parse_ok"), F.coalesce("header", none).alias("header"),
        zero("logical_record_count"), zero("data_row_count"), zero("blank_row_count"), zero("column_mismatch_count"), "ends_with_newline",
        F.coalesce("last_five_complete", F.lit(True)).alias("last_five_complete"), "parse_error", "decode_error",
        F.transform(F.coalesce("tail", F.array().cast("array<struct<n:long,tokens:array<string>>>")), lambda r: r["tokens"]).alias("last_five"),
        F.coalesce("observed_date_tokens", none).alias("observed_date_tokens"), text.path_date_token(date_part).alias("expected_date"),
    )
    return audited.withColumn("date_status", date_status()).withColumn("terminal_truncation_candidate", truncation_candidate())


ZIP_SCHEMA = (
    "airport_id string, relative_path string, zip_valid boolean, zip_bad_member string, zip_error string, member_path string, member_size_bytes long,"
    " compressed_bytes long, compress_type int, member_crc32 string"
)


def audit_zip(contents: DataFrame) -> DataFrame:
    """One row per archive member, or one row with an error for an unreadable archive."""
    def audit(batches):
        import pandas as pd

        names = [c.split()[0] for c in ZIP_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for airport, path, content in zip(batch.airport_id, batch.relative_path, batch.content):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                        bad = archive.testzip()
                        members = [i for i in archive.infolist() if not i.is_dir()]
                        rows += [(airport, path, bad is None, bad, None, i.filename.replace("\\", "/"), i.file_size, i.compress_size, i.compress_type, f"{i.CRC:08x}") for i in members]
                        if not members:
                            rows.append((airport, path, bad is None, bad, None, None, None, None, None, None))
                except (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError) as error:
                    rows.append((airport, path, False, None, f"{type(error).__name__}: {error}", None, None, None, None, None))
            yield pd.DataFrame(rows, columns=names)

    files = contents.filter(F.lower("relative_path").endswith(".zip")).select("airport_id", "relative_path", "content")
    return files.mapInPandas(audit, ZIP_SCHEMA)


class _Piece(InputPartition):
    def __init__(self, path, member, start, end):
        self.path, self.member, self.start, self.end = path, member, start, end


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.split_bytes = int(options.get("splitBytes", 0))

    def partitions(self):
        pieces = []
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                path = os.path.join(folder, name)
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(path) as archive:
                        pieces += [_Piece(path, i.filename, 0, -1) for i in archive.infolist() if i.filename.lower().endswith(".csv")]
                elif name.lower().endswith(".csv"):
                    size, step = os.path.getsize(path), self.split_bytes
                    starts = range(0, max(size, 1), step) if step > 0 else [0]
                    pieces += [_Piece(path, None, s, min(s + step, size) if step > 0 else -1) for s in starts]
        return pieces or [_Piece("", None, 0, 0)]

    def _lines(self, piece):
        """Text lines of a byte range: from the first line that starts in it to the last one that does."""
        with open(piece.path, "rb") as handle:
            handle.seek(max(piece.start - 1, 0))
            if piece.start:
                handle.readline()
            while handle.tell() < piece.end:
                line = handle.readline()
                if not line:
                    return
                yield line.decode("utf-8-sig" if handle.tell() == len(line) else "utf-8", errors="replace")

    def read(self, piece):
        if not piece.path:
            return
        csv.field_size_limit(1 << 27)
        relative = os.path.relpath(piece.path, self.root).replace(os.sep, "/")
        if piece.end >= 0:
            rows = csv.reader(self._lines(piece))
            with open(piece.path, encoding="utf-8-sig", errors="replace", newline="") as handle:
                header = next(csv.reader(handle), None)
            if piece.start == 0:
                next(rows, None)
            for line, row in enumerate(rows):
                yield relative, None, piece.start, line, header, row
            return
        if piece.member is None:
            with open(piece.path, encoding="utf-8-sig", errors="replace", newline="") as handle:
                yield from self._records(relative, None, handle)
        else:
            with zipfile.ZipFile(piece.path) as archive, archive.open(piece.member) as raw:
                yield from self._records(relative, piece.member, io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))

    def _records(self, relative, member, handle):
        rows = csv.reader(handle)
        header = next(rows, None)
        for line, row in enumerate(rows):
            yield relative, member, 0, line, header, row


class RawRecords(DataSource):
    """CSV files and CSV members of ZIP archives on a shared folder, as token rows.

    Archives give one partition per member, since deflate cannot be split. Plain files are cut every
    `splitBytes` bytes when that option is set; quoted line breaks then must not occur.
    """

    @classmethod
    def name(cls):
        return "raw_records"

    def schema(self):
        return "relative_path string, archive_member string, piece_start long, line long, header array<string>, tokens array<string>"

    def reader(self, schema):
        return _RecordReader(self.options)


def read_records(spark: SparkSession, root: str, split_bytes: int = 0) -> DataFrame:
    spark.dataSource.register(RawRecords)
    return prepare(spark).read.format("raw_records").option("splitBytes", str(split_bytes)).load(root)


def logical_records(records: DataFrame, dispositions: DataFrame | None = None, keys: tuple[str, ...] = ("relative_path", "member"),
                    block: str = "piece_start", order: tuple[str, ...] = ("piece_start", "line")) -> DataFrame:
    """Nonblank rows with their row number (the first data row is 2) and 0-based ordinal per source.

    A source with the terminal-drop disposition loses its last nonblank row. Sources are numbered piece by
    piece, so one large source does not fall to a single task.
    """
    names = list(keys)
    blank = F.forall("tokens", lambda t: F.trim(t) == "")
    marked = records.withColumn("kept_", (~blank).cast("long"))
    numbered = blocked_row_number(marked, names, block, list(order), "n_")
    counted = blocked_running_sum(numbered, names, block, list(order), "kept_", "ordinal_")
    rows = counted.filter("kept_ = 1").withColumn("source_row_number", F.col("n_") + 1).withColumn("logical_record_ordinal", F.col("ordinal_") - 1)
    rows = rows.drop("kept_", "n_", "ordinal_")
    if dispositions is None:
        return rows
    last = rows.groupBy(*names).agg(F.max("logical_record_ordinal").alias("last_"))
    dropped = last.join(dispositions.filter(F.col("disposition") == DROP_TERMINAL), names).select(*names, F.col("last_").alias("logical_record_ordinal"))
    return rows.join(dropped, names + ["logical_record_ordinal"], "left_anti")


def with_row_identity(rows: DataFrame, source: str, ordinal: str, out: str = "raw_row_id") -> DataFrame:
    """Stable identity of a record within its source."""
    return rows.withColumn(out, F.sha2(F.concat(F.lit('{"ordinal":'), F.col(ordinal).cast("string"), F.lit(',"source":"'), F.col(source), F.lit('"}')), 256))


def verify_sources(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Sources whose size, checksum or digest differs from the manifest, or that are absent."""
    seen = observed.select("airport_id", "relative_path", *[F.col(c).alias(f"seen_{c}") for c in ("size_bytes", "crc32", "sha256")])
    joined = manifest.join(seen, ["airport_id", "relative_path"], "left")
    problem = (
        F.when(F.col("seen_sha256").isNull(), "missing").when(F.col("seen_size_bytes") != F.col("size_bytes"), "size")
        .when(F.col("seen_crc32") != F.col("crc32"), "crc32").when(F.col("seen_sha256") != F.col("sha256"), "sha256")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("airport_id", "relative_path", "problem")
