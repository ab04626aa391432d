"""Exact deduplication with a two-pass Bloom filter.

Pass one hashes every text to 64 bits and sets two filter positions per row. A position set by more than one row
is kept as "repeated"; those positions are packed into bitmaps. Pass two tests every row: only rows whose two
positions are both repeated can have a copy. These rows are grouped by SHA-256 (a shuffle); all others
pass straight through. The filter never decides equality, so its false positives cost a shuffle and nothing else.

Nulls: a null text counts as empty. A null doc_id is smaller than any other. Rows equal in text and doc_id: one
of them stays. Empty tables give empty results.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tracklens.llm.common import ROW, digest, field_of, join_on_group, packed, table, text_of, unpacked
from tracklens.session import stage_table

BITS_PER_POSITION_SET = 8
BROADCAST_FILTER_BYTES = 64 << 20
BLOCK_BITS = 15


def _positions(rows: int) -> tuple[Column, Column, int]:
    bits = 1 << max(BLOCK_BITS, (max(rows, 1) * BITS_PER_POSITION_SET - 1).bit_length())
    first = F.col("hash_").bitwiseAND(F.lit(bits - 1))
    second = F.xxhash64("hash_").bitwiseAND(F.lit(bits - 1)) + F.lit(bits)
    return first, second, bits


def repeated_filter(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Bitmaps of the positions that more than one row of `hash_` sets, and the filter's largest size in bytes."""
    first, second, bits = _positions(rows)
    repeated = (
        hashes.select(F.explode(F.array(first, second)).alias("position_"))
        .groupBy("position_").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1")
    )
    blocks = repeated.groupBy(F.shiftright("position_", BLOCK_BITS).alias("block_")).agg(
        F.expr(f"bitmap_construct_agg(position_ & {(1 << BLOCK_BITS) - 1})").alias("bits_")
    )
    return stage_table(blocks, "bloom"), 2 * bits // 8


def flag_repeated(df: DataFrame, blocks: DataFrame, size: int, rows: int) -> DataFrame:
    """Add `maybe_`: both positions of the row's `hash_` are set. The filter is broadcast only if it fits its bound."""
    first, second, _ = _positions(rows)
    flagged = df
    for number, position in enumerate((first, second)):
        side = blocks.select(F.col("block_").alias(f"block_{number}"), F.col("bits_").alias(f"bits_{number}"))
        side = F.broadcast(side) if size <= BROADCAST_FILTER_BYTES else side
        flagged = flagged.withColumn(f"at_{number}", position)
        flagged = flagged.join(side, F.shiftright(f"at_{number}", BLOCK_BITS) == F.col(f"block_{number}"), "left")

    def is_set(number: int) -> str:
        inner = f"(at_{number} & {(1 << BLOCK_BITS) - 1})"
        byte = f"CAST(conv(hex(substring(bits_{number}, CAST({inner} >> 3 AS INT) + 1, 1)), 16, 10) AS INT)"
        return f"coalesce(({byte} >> CAST({inner} & 7 AS INT)) & 1, 0) = 1"

    return flagged.select(*df.columns, F.expr(f"{is_set(0)} AND {is_set(1)}").alias("maybe_"))


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of equal texts stays. Only digests are staged and shuffled, never texts.
    """
    rows = packed(docs).select(field_of(doc_id).alias("id_"), digest(text_of(text)).alias("sha_"), F.xxhash64(text_of(text)).alias("hash_"))
    digests = stage_table(rows.withColumn("line_", F.monotonically_increasing_id()), "digests")
    total = digests.count()
    blocks, size = repeated_filter(digests, total)
    flagged = flag_repeated(digests, blocks, size, total)
    alone = flagged.filter("NOT maybe_").select("id_", "sha_", F.col("id_").alias("keep_"), F.lit(1).cast("long").alias("size_"), F.lit(True).alias("kept_"))
    candidates = stage_table(flagged.filter("maybe_").select("id_", "sha_", "line_"), "candidates")
    groups = stage_table(candidates.groupBy("sha_").agg(F.max(F.struct("id_", "line_")).alias("top_"), F.count(F.lit(1)).alias("size_")), "groups")
    grouped = join_on_group(candidates, groups, "sha_", "size_", ["top_", "size_"], total, ["line_"]).select(
        "id_", "sha_", F.col("top_.id_").alias("keep_"), "size_", (F.col("line_") == F.col("top_.line_")).alias("kept_")
    )
    return alone.unionByName(grouped).select(
        F.col("id_").alias("doc_id"), F.col("keep_").alias("keep_id"), F.col("size_").alias("group_size"),
        F.col("kept_").alias("kept"), F.lower(F.hex("sha_")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id.

    Rows outside the filter pass without a shuffle. Groups are reduced on the map side first. Rows equal in text
    and doc_id are ranked by their other orderable columns.
    """
    base = packed(docs).withColumn("hash_", F.xxhash64(text_of(text)))
    total = base.count()
    blocks, size = repeated_filter(base.select("hash_"), total)
    flagged = flag_repeated(base, blocks, size, total)
    others = [f.name for f in docs.schema.fields if f.name not in (doc_id, text) and isinstance(f.dataType, T.AtomicType)]
    rank = F.struct(field_of(doc_id).alias("id_"), *[field_of(name).alias(f"c{i}") for i, name in enumerate(others)])
    kept = flagged.filter("maybe_").groupBy(digest(text_of(text)).alias("sha_")).agg(F.max_by(ROW, rank).alias(ROW)).select(ROW)
    alone = flagged.filter("NOT maybe_").select(ROW)
    return alone.unionByName(kept).select(*unpacked(alone, docs))


def op10_exact_dedup(spark, sf_dir) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM d"""
