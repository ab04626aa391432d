"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Toxic documents go, equal texts and near-duplicates keep one document, contaminated documents go, and the rest is mixed
by source weight. The last stage returns the mixed sequence: documents' columns, with `mix_repeat` and `mix_finish`.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracklens.llm.common import table
from tracklens.llm.decontamination import drop_contaminated
from tracklens.llm.exact_dedup import drop_duplicates
from tracklens.llm.learning import fold
from tracklens.llm.mixing import mix
from tracklens.llm.similar import drop_similar
from tracklens.llm.toxicity import drop_toxic
from tracklens.session import prepare, stage_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(prepare(spark), sf_dir, "labels", "doc_id", "toxic"), fold(F.col("label_id_"), 4) != 2)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return drop_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(prepare(spark), sf_dir, "benchmark", "item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
