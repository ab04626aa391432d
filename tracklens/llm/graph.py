"""Connected components of an edge table with alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from tracklens.llm.common import join_on_group, scalar
from tracklens.session import stage_table


def _star(pairs: DataFrame, total: int, larger: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of node and neighbours: the larger ones, or the node and its smaller ones."""
    least = stage_table(pairs.groupBy("u_").agg(F.min("v_").alias("m_"), F.count(F.lit(1)).alias("degree_")).withColumn("m_", F.least("u_", "m_")), "least")
    joined = join_on_group(pairs, least, "u_", "degree_", ["m_"], total, ["v_"])
    if larger:
        return joined.filter("v_ > u_").select(F.col("v_").alias("u_"), F.col("m_").alias("v_"))
    return joined.select(F.col("v_").alias("u_"), F.col("m_").alias("v_")).unionByName(least.select("u_", F.col("m_").alias("v_"))).filter("u_ <> v_")


def components(edges: DataFrame) -> DataFrame:
    """Nodes other than their component's smallest, with that smallest node: columns node_, root_. `edges` has long a_, b_."""
    def state(df):
        return tuple(scalar(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u_", "v_"), F.lit(1 << 40))))))

    current = stage_table(edges.filter("a_ <> b_").select(F.greatest("a_", "b_").alias("u_"), F.least("a_", "b_").alias("v_")).distinct(), "edges")
    before = state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v_").alias("u_"), F.col("u_").alias("v_")))
        large = stage_table(_star(both, 2 * before[0], True).distinct(), "large")
        current = stage_table(_star(large, large.count(), False).distinct(), "small")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u_").alias("node_"), F.col("v_").alias("root_"))
