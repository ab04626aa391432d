"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon holds words and word beginnings whose share among toxic training texts is much larger than among others. It is
learned from one part of the labelled sample, the trees from a second and the calibration from a third, so no stage
sees scores that were fitted to its own rows. Features: lexicon densities, distance of lexicon hits to second-person
words, capitals, punctuation and obfuscation.

The sample is bounded by `SAMPLE` labelled rows; everything else reads whole tables and whole texts.
Nulls: a null text counts as empty and is scored; a null id is never a label's. Repeated rows give one row each. Without labels of both classes
every score is the share of label 1 (0 if there are none).
"""

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tracklens.llm.common import field_of, packed, table, text_of
from tracklens.llm.learning import fold, labelled_sample
from tracklens.session import stage_table

SAMPLE = 20_000
LEXICON = 2_000
BEGINNINGS = (4, 5)
LEAST_TEXTS = 5
LEAST_ODDS = 3.0
TREES = 20
DEPTH = 4
THRESHOLD = 0.3
# Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú usted ustedes ti tus su vosotros".split())
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
EDGE = ".,;:!?\"'()[]{}<>|*#%&$~`-_=+/\\…«»"
FEATURES = ["words", "hits", "density", "strongest", "second", "evidence", "near_person", "disguised_hits", "capitals", "shouted", "marks", "exclaims", "mixed", "repeats"]


def tokens(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon entries."""
    return [word] + [word[:n] + "~" for n in BEGINNINGS if len(word) > n]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = text.split()
    n = len(words) or 1
    plain = [w.strip(EDGE).lower() for w in words]
    odds, disguised = {}, 0
    for word, count in Counter(plain).items():
        best = max((lexicon.get(t, 0.0) for t in tokens(word)), default=0.0)
        if not best and not word.isalpha():
            bare = word.translate(DISGUISE)
            bare = "".join(c for c in bare if c.isalpha())
            best = max((lexicon.get(t, 0.0) for t in tokens(bare)), default=0.0) if bare and bare != word else 0.0
            disguised += count if best else 0
        if best:
            odds[word] = (best, count)
    ranked = sorted((v for v, _ in odds.values()), reverse=True) + [0.0, 0.0]
    hits = sum(c for _, c in odds.values())
    nearest = 1 << 20
    if hits:
        persons = [i for i, w in enumerate(plain) if w in SECOND_PERSON]
        spots = [i for i, w in enumerate(plain) if w in odds]
        at = 0
        for spot in spots:
            while at + 1 < len(persons) and persons[at + 1] <= spot:
                at += 1
            nearest = min([nearest] + [abs(p - spot) for p in persons[at:at + 2]])
    letters = sum(map(str.isalpha, text)) or 1
    return [
        math.log1p(len(words)), float(hits), 100.0 * hits / n, ranked[0], ranked[1], sum(ranked[:5]), 1.0 / (1 + nearest), float(disguised),
        sum(map(str.isupper, text)) / letters, sum(1 for w in words if len(w) > 2 and w.isupper()) / n,
        sum(1 for c in text if not c.isalnum() and not c.isspace()) / (len(text) or 1), 100.0 * text.count("!") / n,
        sum(1 for w in plain if w and not w.isalpha() and any(map(str.isalpha, w))) / n, sum(1 for a, b, c in zip(text, text[1:], text[2:]) if a == b == c) / (len(text) or 1),
    ]


def _entries(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct lexicon entries of each row's `text_` as `token_`."""
    import pyarrow as pa

    at = df.columns.index("text_")
    schema = T.StructType([T.StructField("tokens_", T.ArrayType(T.StringType())) if f.name == "text_" else f for f in df.schema.fields])

    def run(batches):
        for batch in batches:
            found = [sorted({t for w in set(text.as_py().split()) for t in tokens(w.strip(EDGE).lower()) if t}) for text in batch.column(at)]
            yield batch.set_column(at, "tokens_", pa.array(found, pa.list_(pa.string())))

    return df.mapInArrow(run, schema).select(*columns, F.explode("tokens_").alias("token_"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """At most LEXICON entries with their log odds, from rows of `text_` and `label_`."""
    sizes = {r.label_: r.n for r in sample.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    counts = _entries(sample.select("label_", "text_"), ["label_"]).groupBy("token_").agg(
        F.sum("label_").alias("toxic_"), F.sum(1 - F.col("label_")).alias("clean_")
    ).filter(F.col("toxic_") >= LEAST_TEXTS)
    odds = F.log((F.col("toxic_") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean_") + 0.5) / (clean + 1.0))
    best = counts.withColumn("odds_", odds).filter(F.col("odds_") >= LEAST_ODDS).orderBy(F.desc("odds_"), "token_").limit(LEXICON)
    return {r.token_: float(r.odds_) for r in best.select("token_", "odds_").collect()}


def featured(df: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Replace `text_` by the dense features."""
    import pyarrow as pa

    at = df.columns.index("text_")
    others = [f for f in df.schema.fields if f.name != "text_"]
    schema = T.StructType(others + [T.StructField(f"f_{n}", T.DoubleType()) for n in FEATURES])

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py(), lexicon) for t in batch.column(at)]
            columns = list(zip(*rows)) if rows else [[] for _ in FEATURES]
            kept = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.float64()) for c in columns], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", payload: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """Rows id_ and score_ (and payload_, if asked for). `learn_from` is a condition on `label_id_`: labels that may be used."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    chosen = stage_table(labelled_sample(labels, doc_id, label, learn_from, sample), "labels")
    base = packed(docs).select(field_of(doc_id).alias("id_"), text_of(text).alias("text_"))
    drawn = stage_table(base.join(F.broadcast(chosen), F.col("id_") == F.col("label_id_")).select("text_", "label_", F.pmod("draw_", F.lit(10)).alias("part_")), "sample")
    lexicon = learn_lexicon(drawn.filter("part_ < 4"))
    more = [] if payload is None else [payload.alias("payload_")]
    every = featured(packed(docs).select(field_of(doc_id).alias("id_"), *more, text_of(text).alias("text_")), lexicon)
    assemble = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features_")
    known = assemble.transform(featured(drawn.filter("part_ >= 4"), lexicon)).select("features_", "label_", "part_")
    known = stage_table(known, "known")
    seen = known.groupBy("label_").agg(F.min(F.col("part_") >= 8).alias("late"), F.max(F.col("part_") >= 8).alias("any_late"), F.count(F.lit(1)).alias("n")).collect()
    passed = ["id_"] + ["payload_"] * len(more)
    if len(seen) < 2 or any(r.late for r in seen):
        total = sum(r.n for r in seen)
        return every.select(*passed, F.lit(sum(r.n for r in seen if r.label_ == 1) / total if total else 0.0).alias("score_"))
    trees = GBTClassifier(featuresCol="features_", labelCol="label_", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, minInstancesPerNode=5).fit(known.filter("part_ < 8"))
    raw = lambda df: trees.transform(df).withColumn("margin_", vector_to_array("probability")[1])
    late = raw(known.filter("part_ >= 8"))
    curve = IsotonicRegression(featuresCol="margin_", labelCol="label_", predictionCol="score_").fit(late) if not late.isEmpty() else None
    scored = raw(assemble.transform(every))
    scored = curve.transform(scored) if curve else scored.withColumn("score_", F.col("margin_"))
    return scored.select(*passed, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score_"))).alias("score_"))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    scored = score_toxicity(docs, labels, learn_from, doc_id, text, payload=F.col("row_"))
    return scored.filter(F.col("score_") < threshold).select(*[F.col(f"payload_.`{name}`").alias(name) for name in docs.columns])


def op7_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = score_toxicity(docs, labels, fold(F.col("label_id_"), 4) != 2)
    return scored.select(F.col("id_").alias("doc_id"), (fold(F.col("id_"), 4) == 2).alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= THRESHOLD).cast("int").alias("predicted"))
