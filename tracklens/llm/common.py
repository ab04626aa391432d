"""Helpers shared by the operators of this subpackage.

Every operator first packs the caller's columns into one struct `row_`, so extra columns may have any name.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracklens.session import prepare, stage_table

ROW = "row_"
HEAVY_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*(columns or ["*"]))


def packed(df: DataFrame) -> DataFrame:
    """All columns of the caller as one struct, out of the way of the operator's own names."""
    return df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias(ROW))


def unpacked(df: DataFrame, like: DataFrame) -> list[Column]:
    return [F.col(f"{ROW}.`{name}`").alias(name) for name in like.columns]


def text_of(column: str) -> Column:
    """The text of a packed row; null counts as empty."""
    return F.coalesce(F.col(f"{ROW}.`{column}`"), F.lit(""))


def field_of(column: str) -> Column:
    return F.col(f"{ROW}.`{column}`")


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def lowered(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once: a lambda variable is not inlined into inner lambdas."""
    return F.transform(F.array(value), body)[0]


def scalar(df: DataFrame):
    """The one row of an aggregate without grouping."""
    return df.first()


def join_on_group(rows: DataFrame, groups: DataFrame, key: str, size: str, values: list[str], total: int, spread: list[str]) -> DataFrame:
    """Left-join facts of each group to its rows, whatever the largest group's share is.

    `groups` has one row per key with its number of rows. A key with over a thousandth of all rows is heavy; there
    are under a thousand of those by arithmetic, so they are broadcast. Rows of heavy keys get a spread
    second key and go on evenly through the shuffle join that serves all other keys.
    """
    is_heavy = F.col(size) * HEAVY_SHARE > F.lit(total)
    heavy = groups.filter(is_heavy).select(F.col(key).alias("heavy_key_"), F.struct(*values).alias("heavy_value_"))
    light = groups.filter(~is_heavy).select(F.col(key).alias("light_key_"), F.lit(0).cast("long").alias("light_lane_"), F.struct(*values).alias("light_value_"))
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("heavy_key_"), "left").withColumn(
        "lane_", F.when(F.col("heavy_key_").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20)))
    )
    joined = marked.join(light, (F.col(key) == F.col("light_key_")) & (F.col("lane_") == F.col("light_lane_")), "left")
    found = F.coalesce("heavy_value_", "light_value_")
    return joined.select(*rows.columns, *[found[name].alias(name) for name in values])


def ranged_running_sum(df: DataFrame, order: list[str], values: list[str], name: str) -> DataFrame:
    """Running sums of long columns in one global order, staged as range partitions: adds `run_<value>` and `part_`.

    Each range is summed on its own and one row per range carries the offsets, so neither a key nor the whole
    table meets in one task. Rows equal in the whole order may come in any sequence.
    """
    import numpy as np
    import pyarrow as pa

    from pyspark.sql import types as T

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    schema = T.StructType(ranged.schema.fields + [T.StructField(f"run_{v}", T.LongType()) for v in values])

    def accumulate(batches):
        carry = {v: 0 for v in values}
        for batch in batches:
            for v in values:
                run = np.cumsum(batch.column(v).to_numpy(zero_copy_only=False).astype("int64")) + carry[v]
                if len(run):
                    carry[v] = int(run[-1])
                batch = batch.append_column(f"run_{v}", pa.array(run, pa.int64()))
            yield batch

    staged = stage_table(ranged.mapInArrow(accumulate, schema), name)
    from pyspark.sql import Window

    parts = staged.groupBy("part_").agg(F.min(F.struct(*order)).alias("low_"), *[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("low_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part_", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"offset_{v}") for v in values])
    joined = staged.join(F.broadcast(offsets), "part_")
    return joined.select(*df.columns, *[(F.col(f"run_{v}") + F.col(f"offset_{v}")).alias(f"run_{v}") for v in values])
