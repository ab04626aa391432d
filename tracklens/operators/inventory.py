"""Manifest-level audits: summaries, header variants, calendars, archive matching and source order."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tracklens.functions import text
from tracklens.operators.evaluate import one_row_join
from tracklens.operators.ordered import blocked_row_number, exact_quantiles

EXCLUDED = ("exclude_non_data_file", "exclude_source_corrupt_file")


def summarize_audit(manifest: DataFrame) -> DataFrame:
    """One row of structural counts. Content duplicates are counted from hash groups."""
    csv, zipped = F.col("audit_type") == "csv", F.col("audit_type") == "zip"
    counts = manifest.agg(
        F.count(F.lit(1)).alias("files_discovered"),
        F.count_if(F.length("sha256") == 64).alias("files_audited"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.count_if(csv).alias("csv_count"), F.count_if(zipped).alias("zip_count"), F.count_if(~csv & ~zipped).alias("other_file_count"),
        F.count_if(F.col("sha256").isNull() | (F.col("sha256") == "")).alias("missing_hash_count"),
        F.count_if(~F.coalesce("readable", F.lit(False))).alias("unreadable_count"),
        F.count_if(csv & ~F.coalesce("strict_parse_ok", F.lit(False))).alias("strict_parse_failures"),
        F.count_if(csv & F.col("decode_error").isNotNull()).alias("decode_failures"),
        F.count_if(csv & F.col("is_empty")).alias("empty_csv_count"),
        F.count_if(csv & F.col("header_only")).alias("header_only_csv_count"),
        F.count_if(csv & (F.col("blank_row_count") > 0)).alias("blank_row_files"),
        F.count_if(csv & (F.col("column_mismatch_count") > 0)).alias("column_mismatch_files"),
        F.count_if(csv & ~F.col("ends_with_newline") & ~F.col("is_empty")).alias("missing_final_newline_files"),
        F.count_if(csv & (F.col("date_status") == "mismatch")).alias("date_mismatch_files"),
        F.count_if(zipped & ~F.coalesce("zip_valid", F.lit(False))).alias("invalid_zip_count"),
        F.count_if("is_symlink").alias("symlink_count"),
    )
    repeated = (
        manifest.filter("sha256 IS NOT NULL AND sha256 <> ''").groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .agg(F.count(F.lit(1)).alias("duplicate_hash_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_file_count"))
    )
    return one_row_join(counts, repeated)


def decide(summary: DataFrame) -> DataFrame:
    """Blocking rules: the names of those that fail, and the decision."""
    blocking = ["missing_hash_count", "unreadable_count", "invalid_zip_count", "symlink_count"]
    failed = [F.when(F.col("files_discovered") == 0, "no_files"), F.when(F.col("files_audited") != F.col("files_discovered"), "coverage")]
    failed += [F.when(F.col(c) > 0, c) for c in blocking]
    return summary.select(F.array_compact(F.array(*failed)).alias("blockers")).withColumn(
        "decision", F.when(F.size("blockers") == 0, "proceed").otherwise("revise")
    )


def header_variants(manifest: DataFrame, samples: int = 10) -> DataFrame:
    """Exact header groups with their airports and the first few paths.

    Paths are ranked, not collected, so a header shared by most files stays small in memory.
    """
    csv = manifest.filter((F.col("audit_type") == "csv") & (F.size("header") > 0))
    totals = csv.groupBy("header").agg(F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_set("airport_id")).alias("airports"))
    rank = Window.partitionBy("header").orderBy("relative_path")
    first = csv.select("header", "relative_path").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= samples)
    paths = first.groupBy("header").agg(F.array_sort(F.collect_list("relative_path")).alias("sample_paths"))
    return totals.join(paths, "header")


def date_coverage(manifest: DataFrame) -> DataFrame:
    """Calendar of each airport between its first and last file date, with missing days marked."""
    csv = manifest.filter("audit_type = 'csv'").withColumn("date", text.token_date(F.col("date_directory"))).filter("date IS NOT NULL")
    days = csv.groupBy("airport_id", "date").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("size_bytes"))
    calendar = days.groupBy("airport_id").agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        "airport_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    return calendar.join(days, ["airport_id", "date"], "left").fillna(0).withColumn("missing", F.col("file_count") == 0)


def size_distribution(manifest: DataFrame) -> DataFrame:
    """Size quantiles by airport and extension, linearly interpolated."""
    size = F.coalesce("size_bytes", F.lit(0))
    keys = ["airport_id", "extension"]
    points = {"p01_bytes": 0.01, "p25_bytes": 0.25, "median_bytes": 0.5, "p75_bytes": 0.75, "p99_bytes": 0.99}
    sized = manifest.select(*keys, size.alias("size"))
    totals = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("file_count"), F.min("size").alias("min_bytes"), F.max("size").alias("max_bytes"), F.sum("size").alias("total_bytes"),
    )
    # Blocks double in width, so any range of sizes falls into a few dozen of them.
    return totals.join(exact_quantiles(sized, keys, "size", points, F.floor(F.log2(F.col("size") + 1.0) * 8)), keys)


def archive_comparison(archives: DataFrame, extracted: DataFrame) -> DataFrame:
    """Match archive members to extracted files: exact on size and checksum, else the first candidate by path."""
    keyed = extracted.select(
        "airport_id", "year", text.path_date_token(F.col("relative_path")).alias("member_date"),
        F.lower(F.element_at(F.split("relative_path", "/"), -1)).alias("member_filename"),
        F.col("relative_path").alias("e_path"), F.col("size_bytes").alias("e_size"), F.lower("crc32").alias("e_crc"),
    ).filter("member_date IS NOT NULL AND member_filename LIKE '%.csv'")
    # The first path per key, and the first path per key with each size and checksum: one row per distinct
    # content, so a key with very many copies never meets the members as a whole.
    keys = ["airport_id", "year", "member_date", "member_filename"]
    exact = keyed.groupBy(*keys, "e_size", "e_crc").agg(F.min("e_path").alias("exact_path"))
    any_file = keyed.groupBy(*keys).agg(F.min(F.struct("e_path", "e_size", "e_crc")).alias("first_file"))
    members = archives.select(
        "airport_id", "year", "zip_valid", F.col("relative_path").alias("archive_relative_path"), "member_path", "member_size_bytes",
        F.lower("member_crc32").alias("member_crc32"), text.path_date_token(F.col("member_path")).alias("member_date"),
        F.lower(F.element_at(F.split("member_path", "/"), -1)).alias("member_filename"),
    ).filter("member_date IS NOT NULL AND member_filename LIKE '%.csv'")
    matched = (
        members.join(exact.withColumnsRenamed({"e_size": "member_size_bytes", "e_crc": "member_crc32"}), keys + ["member_size_bytes", "member_crc32"], "left")
        .join(any_file, keys, "left")
    )
    status = (
        F.when(~F.coalesce("zip_valid", F.lit(False)), "archive_unverified").when(F.col("exact_path").isNotNull(), "exact_match")
        .when(F.col("first_file").isNull(), "missing_extracted_recoverable").otherwise("content_mismatch_recoverable")
    )
    return matched.select(
        "airport_id", "archive_relative_path", "member_path", "member_date", "member_filename", "member_size_bytes", "member_crc32",
        F.coalesce("exact_path", "first_file.e_path").alias("extracted_relative_path"), status.alias("status"),
    )


def eligible_sources(manifest: DataFrame) -> DataFrame:
    """Data files that earlier checks did not exclude."""
    return manifest.filter((F.col("extension") == ".csv") & ~F.col("disposition").isin(*EXCLUDED))


def ordered_sources(manifest: DataFrame, out: str = "source_sequence") -> DataFrame:
    """0-based order within an airport: calendar directory, natural file name, path. Undated files come last."""
    keyed = manifest.withColumn("day_", F.coalesce(text.token_date(F.col("date_directory")), F.lit("9999-12-31").cast("date"))).withColumn(
        "name_", text.natural_name_key(F.col("filename"))
    ).withColumn("fold_", F.lower("relative_path"))
    order = ["day_", "name_", "fold_", "relative_path"]
    ranked = blocked_row_number(keyed, ["airport_id"], "day_", order, "n_")
    return ranked.withColumn(out, F.col("n_") - 1).drop("day_", "name_", "fold_", "n_")


def registry_checks(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Lineage checks: every source in the manifest, unique identities, contiguous 0-based sequence."""
    def violations(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    span = sources.groupBy("airport_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_sequence").alias("d"), F.min("source_sequence").alias("a"), F.max("source_sequence").alias("b")
    )
    checks = [
        violations("source_missing_from_manifest", sources.join(manifest, ["airport_id", "relative_path"], "left_anti")),
        violations("repeated_source", sources.groupBy("airport_id", "relative_path").count().filter("count > 1")),
        violations("sequence_not_contiguous", span.filter("a <> 0 OR b <> n - 1 OR d <> n")),
    ]
    return reduce(lambda x, y: x.unionByName(y), checks)


def round_robin_files(manifest: DataFrame, per_airport: int, buckets: list[str]) -> DataFrame:
    """Stable round-robin pick across buckets, `per_airport` files each."""
    turn = Window.partitionBy("airport_id", *buckets).orderBy("relative_path")
    # No bucket can give more than the whole quota, so the limit applies before the second ranking.
    turns = manifest.withColumn("turn_", F.row_number().over(turn)).filter(F.col("turn_") <= per_airport)
    pick = Window.partitionBy("airport_id").orderBy("turn_", *buckets)
    return turns.withColumn("pick_", F.row_number().over(pick)).filter(F.col("pick_") <= per_airport).drop("turn_", "pick_")
