"""Sharding by sampled splitters: shards of near equal bytes in the order of a text key.

The key of a row is the first 60 bits of its text's SHA-256, then its id, so equal texts are neighbours. Rows are drawn with a chance in
proportion to their size; quantiles of the draw cut the key order into many ranges. Ranges whose exact count or
bytes come out above twice the mean are overfull: they are drawn from again, by bytes and by rows, and subdivided until none is left. A crowd of
equal texts is cut by id, so no key is too large. Rows move once, to their range; inside a range bytes are summed in key
order, one row per range carries the sums before it, and the middle byte of a row says which shard it belongs to.

Law `bytes`: a cut lies within half a row of its place; a group of equal texts of at most 1 / `TOGETHER` of a shard stays whole, at the
shard of its middle, so there a cut may be off by half such a group. Larger groups are divided. Shards times bytes must stay below 4 * 10^18.

The splitters only say where work is done; shards and slots follow from the order, so they do not depend on the draw or on partitions.

Nulls: a null text has no bytes and counts as empty; a null id comes before all others. Rows equal in text and id take neighbouring slots in any
order. An empty table gives an empty result. A column of the caller named like the result's `shard` or `slot` gives way to it.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens.llm.common import ROW, field_of, packed, scalar, table, text_of
from tracklens.session import stage_table

SHARDS = 24
OVERHEAD = 8  # bytes of a row besides its text
TOGETHER = 100
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 500_000  # ranges grow in number with the rows, not in length
LEAST_ROWS = 64
DRAWS = 64  # per range
STEP_BITS = 10
LEVELS = 6
KEY = ["key_", "id_", "line_"]


def _key() -> Column:
    return F.struct(*KEY)


def _stats(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"), F.sum("size_").alias("bytes_"))


def draw_splitters(ranged: DataFrame, overfull: DataFrame, level: int) -> DataFrame:
    """Sorted splitters `cuts_` of each overfull range (`range_`, `rows_`, `bytes_`, `pieces_`): quantiles of a draw of `DRAWS` rows for each piece.

    The first draw weighs by bytes; later ones, inside overfull ranges, by bytes and rows alike.
    """
    by_bytes = F.col("size_") / F.col("bytes_")
    weight = by_bytes if level == 0 else (by_bytes + F.lit(1.0) / F.col("rows_")) / 2
    chance = F.pmod(F.xxhash64(F.lit(level), "key_", "line_"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = ranged.join(F.broadcast(overfull) if level < 2 else overfull, "range_").withColumn("times_", F.floor(weight * DRAWS * F.col("pieces_") + chance)).filter("times_ > 0")
    mine = Window.partitionBy("range_")
    run = drawn.withColumn("run_", F.sum("times_").over(mine.orderBy(*KEY))).withColumn("all_", F.sum("times_").over(mine))
    crossed = F.floor(F.col("run_") * F.col("pieces_") / F.col("all_")) > F.floor((F.col("run_") - F.col("times_")) * F.col("pieces_") / F.col("all_"))
    cuts = run.filter(crossed & (F.col("run_") < F.col("all_"))).groupBy("range_").agg(F.array_sort(F.collect_list(_key())).alias("cuts_"))
    return stage_table(cuts, "splitters")


def _subdivided(ranged: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """Range numbers one level deeper: the number of splitters below the row's key, by binary search."""
    joined = ranged.join(F.broadcast(cuts) if level < 2 else cuts, "range_", "left")
    below = F.aggregate(
        F.array(*[F.lit(1 << bit) for bit in reversed(range(STEP_BITS))]), F.lit(0),
        lambda low, step: F.when((low + step <= F.size("cuts_")) & (F.get(F.col("cuts_"), low + step - 1) < _key()), low + step).otherwise(low),
    )
    piece = F.when(F.col("cuts_").isNull(), F.lit(0)).otherwise(below)
    return joined.withColumn("range_", F.shiftleft("range_", STEP_BITS) + piece.cast("long")).drop("cuts_")


def into_ranges(rows: DataFrame, shards: int, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """Staged rows with `range_`, whose numbers follow the key order, and the ranges' rows and bytes.

    At most 2^10 splitters a range and draw, so what the first two draws broadcast is bounded; deeper ones are joined as Spark sees fit.
    """
    total = scalar(rows.agg(F.count(F.lit(1)), F.sum("size_")))
    ranges = max(1, min(shards * RANGES_PER_SHARD, total[0] // LEAST_ROWS), -(-total[0] // rows_per_range))
    rows_mean, bytes_mean = max(1.0, total[0] / ranges), max(1.0, (total[1] or 0) / ranges)
    ranged = rows.withColumn("range_", F.lit(0).cast("long"))
    stats = stage_table(_stats(ranged), "ranges")
    for level in range(LEVELS):
        fullness = F.greatest(F.col("rows_") / rows_mean, F.col("bytes_") / bytes_mean)
        overfull = stats.filter((fullness > 2) & (F.col("rows_") > 1)).withColumn("pieces_", F.least(F.ceil(fullness), F.lit(1 << STEP_BITS)))
        if overfull.isEmpty():
            break
        ranged = _subdivided(ranged, draw_splitters(ranged, overfull, level), level)
        stats = stage_table(_stats(ranged), "ranges")
    return ranged, stats


def _shard_at(twice_middle: str, total: int, shards: int) -> Column:
    """Shard of a byte position, in whole numbers."""
    return F.expr(f"CAST(least({shards - 1}, ({twice_middle}) * {shards} div {2 * max(total, 1)}) AS INT)")


def _ordered(rows: DataFrame, shards: int, rows_per_range: int) -> tuple[DataFrame, int]:
    """Staged rows with `at_` (rows before), `before_` (bytes before) and the shard of their own middle, and all bytes."""
    ranged, stats = into_ranges(rows, shards, rows_per_range)
    total = scalar(stats.agg(F.sum("bytes_")))[0] or 0
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = stats.select("range_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(f"{c}before_") for c in ("rows_", "bytes_")])
    inside = Window.partitionBy("range_").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("at_", F.count(F.lit(1)).over(inside) - 1).withColumn("before_", F.sum("size_").over(inside) - F.col("size_"))
    placed = summed.join(offsets, "range_").withColumn("at_", F.col("at_") + F.col("rows_before_")).withColumn("before_", F.col("before_") + F.col("bytes_before_"))
    own = placed.withColumn("shard_", _shard_at("2 * before_ + size_", total, shards))
    return stage_table(own.drop("range_", "rows_before_", "bytes_before_"), "ordered"), total


def _whole_groups(ordered: DataFrame, total: int, shards: int) -> DataFrame:
    """Small groups of equal texts that a cut would divide, with the shard of their middle: one row for each cut at most."""
    edges = ordered.groupBy("shard_").agg(F.min_by("key_", "at_").alias("first_"), F.max_by("key_", "at_").alias("last_"))
    nearby = Window.orderBy("shard_")  # one row for each shard
    cut = edges.withColumn("last_before_", F.lag("last_").over(nearby)).filter("first_ = last_before_").select(F.col("first_").alias("key_")).distinct()
    groups = ordered.join(F.broadcast(cut), "key_").groupBy("key_").agg(F.min("before_").alias("start_"), F.sum("size_").alias("bytes_"))
    small = groups.filter(F.col("bytes_") * F.lit(TOGETHER * shards) <= F.lit(total))
    return stage_table(small.select(F.col("key_").alias("whole_key_"), _shard_at("2 * start_ + bytes_", total, shards).alias("whole_shard_")), "whole")


def _sharded(docs: DataFrame, doc_id: str, text: str, shards: int, rows_per_range: int, payload: Column) -> DataFrame:
    """Rows `row_` (the payload), id_, size_, shard_ and slot_."""
    base = packed(docs)
    key = F.conv(F.substring(F.sha2(text_of(text), 256), 1, 15), 16, 10).cast("long")
    size = (F.octet_length(text_of(text)) + F.lit(OVERHEAD)).cast("long")
    rows = base.select(payload.alias(ROW), key.alias("key_"), field_of(doc_id).alias("id_"), size.alias("size_"), F.monotonically_increasing_id().alias("line_"))
    ordered, total = _ordered(stage_table(rows, "rows"), shards, rows_per_range)
    whole = _whole_groups(ordered, total, shards)
    named = ordered.join(F.broadcast(whole), F.col("key_") == F.col("whole_key_"), "left").withColumn("shard_", F.coalesce("whole_shard_", "shard_"))
    firsts = stage_table(named.groupBy("shard_").agg(F.min("at_").alias("first_")), "firsts")
    return named.join(F.broadcast(firsts), "shard_").withColumn("slot_", (F.col("at_") - F.col("first_")).cast("long"))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The documents with all their columns, their `shard` and their `slot` in it."""
    placed = _sharded(docs, doc_id, text, shards, rows_per_range, F.col(ROW))
    kept = [F.col(f"{ROW}.`{name}`").alias(name) for name in docs.columns if name not in ("shard", "slot")]
    return placed.select(*kept, F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """Write the shards as Parquet under folder/shard=<number>; a task writes its stretch of one shard in slot order.

    The shards' stretches are cut by bytes already, so sorting inside them moves nothing else.
    """
    shard(docs, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op11_sharding(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    placed = _sharded(docs, "doc_id", "text", SHARDS, ROWS_PER_RANGE, F.struct(F.crc32(text_of("text")).alias("crc_")))
    return placed.select(
        F.col("id_").alias("doc_id"), F.col("size_").alias("size"), F.col(f"{ROW}.crc_").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard_").alias("shard"), F.col("slot_").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


# CRC-32 byte by byte: `tab` is the table of the reflected polynomial 0xEDB88320.
CRC_TABLE_SQL = """e AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 8), lambda acc, k: CASE WHEN acc & 1 = 1 THEN xor(3988292384, acc >> 1) ELSE acc >> 1 END, i) AS c
 FROM (SELECT unnest(range(0, 256)) AS i)))"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1]), 4294967295))"


OP11_SQL = f"""WITH {CRC_TABLE_SQL},
d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
r AS (SELECT *, row_number() OVER w - 1 AS rn, CAST(sum(size) OVER w AS BIGINT) - size AS b, CAST(sum(size) OVER () AS BIGINT) AS total, CAST(sum(size) OVER (PARTITION BY k) AS BIGINT) AS g
 FROM d WINDOW w AS (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, CASE WHEN g * {TOGETHER * SHARDS} <= total THEN 2 * min(b) OVER (PARTITION BY k) + g ELSE 2 * b + size END AS mid FROM r),
s AS (SELECT *, CAST(least({SHARDS - 1}, mid * {SHARDS} // (2 * total)) AS INTEGER) AS shard FROM m)
SELECT doc_id, size, CAST({crc_sql("t")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(rn - min(rn) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s, e"""
