"""Held-out accuracy of the trained operators, and odd input."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tracklens.llm import quality, toxicity
from tracklens.llm.learning import fold

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, parts, held", [(quality.op1_quality, "quality", 5, 0), (toxicity.op7_toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, query, label, parts, held):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = query(spark, MIDDLE).collect()
    assert len(got) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.9 * len(tested)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert score(odd, labels, F.lit(True)).count() == odd.count()
    assert toxicity.drop_toxic(odd, labels.limit(0), fold(F.col("label_id_"), 4) != 2).schema.names == odd.schema.names
    assert quality.score_quality(odd.limit(0), labels, F.lit(True)).count() == 0


def test_prior_and_non_negative_risk():
    random = np.random.default_rng(2)
    positive = random.normal(2, 1, (3000, 3))
    unlabelled = np.concatenate((random.normal(2, 1, (2100, 3)), random.normal(-2, 1, (900, 3))))
    random.shuffle(unlabelled)
    model, prior = quality.fit_quality(positive, unlabelled)
    assert abs(prior - 0.7) < 0.08
    assert (model.margin(random.normal(2, 1, (500, 3))) > 0).mean() > 0.95 and (model.margin(random.normal(-2, 1, (500, 3))) < 0).mean() > 0.95
