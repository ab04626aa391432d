"""Labelled samples and scoring shared by the trained operators."""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import field_of, packed


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id's text modulo a number; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(0).cast("long"))


def labelled_sample(labels: DataFrame, doc_id: str, label: str, learn_from: Column, rows: int) -> DataFrame:
    """At most `rows` labelled ids that may be learned from, chosen by hash: label_id_, label_ (0 or 1), draw_.

    Null ids and labels are left out; of contradicting labels of one id the larger holds.
    """
    known = packed(labels).select(field_of(doc_id).alias("label_id_"), field_of(label).cast("int").alias("label_"))
    known = known.filter("label_id_ IS NOT NULL AND label_ IN (0, 1)").filter(learn_from)
    once = known.groupBy("label_id_").agg(F.max("label_").alias("label_"))
    return once.withColumn("draw_", F.xxhash64(F.lit("sample"), "label_id_")).orderBy("draw_", "label_id_").limit(rows)
