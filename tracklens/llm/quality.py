"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled texts; unlabelled texts are drawn from all documents without looking at any label. The
class prior of the unlabelled texts is estimated as the smallest ratio of their share to the positives' share above a score of
a positive-against-unlabelled model, on rows kept out of its fit. A small network then minimises
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

The fit reads at most `SAMPLE` positives and `SAMPLE` unlabelled rows of dense features; these reach the driver, a few MB whatever the corpus.
Features are computed once, over every whole text.
Nulls: a null text counts as empty and is scored. Repeated rows give one row each. Without positives every score is 0; without
unlabelled rows the table is empty.
"""

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tracklens.llm.common import field_of, packed, table, text_of
from tracklens.llm.learning import fold, labelled_sample
from tracklens.session import stage_table

SAMPLE = 10_000
HIDDEN = 24
STEPS = 600
RATE = 0.02
THRESHOLD = 0.3
FEATURES = [
    "words", "distinct", "commonest", "word_length", "spread", "capitals", "shouted", "digits", "marks", "sentence_marks", "odd_marks", "bars", "exclaims",
    "lines", "line_repeats", "short_words", "run_repeats", "marked_words", "gram_repeats",
]


def features(text: str) -> list[float]:
    """Dense statistics of a whole text; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = Counter(words)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    letters = sum(map(str.isalpha, text)) or 1
    marks = Counter(c for c in text if not c.isalnum() and not c.isspace())
    lines = [x for x in text.split("\n") if x.strip()]
    grams = Counter(zip(words, words[1:], words[2:]))
    common = sum(marks[c] for c in ".,;:?!'\"-()")
    total = sum(marks.values())
    return [
        math.log1p(n), len(counts) / n ** 0.9, max(counts.values()) / n, mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / n),
        sum(map(str.isupper, text)) / letters, sum(1 for w in words if len(w) > 1 and w.isupper()) / n, sum(map(str.isdigit, text)) / size, total / size,
        (marks["."] + marks["?"]) / n, (total - common) / n, marks["|"] / n, marks["!"] / n, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for x in lengths if x <= 3) / n, sum(1 for a, b in zip(words, words[1:]) if a == b) / n,
        sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?") / n, 1 - len(grams) / max(1, n - 2) if n > 2 else 0.0,
    ]


def featured(df: DataFrame) -> DataFrame:
    """Replace `text_` by `features_`, an array of the dense features."""
    import pyarrow as pa

    at = df.columns.index("text_")
    schema = T.StructType([T.StructField("features_", T.ArrayType(T.DoubleType())) if f.name == "text_" else f for f in df.schema.fields])

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(at)]
            yield batch.set_column(at, "features_", pa.array(rows, pa.list_(pa.float64())))

    return df.mapInArrow(run, schema)


class Network:
    """One hidden layer over standardised features; `fit` minimises a risk given the gradient of the outputs."""

    def __init__(self, rows, hidden: int = HIDDEN, seed: int = 3):
        import numpy as np

        random = np.random.default_rng(seed)
        self.center, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        wide = rows.shape[1]
        self.weights = [random.normal(0, wide ** -0.5, (wide, hidden)), np.zeros(hidden), random.normal(0, hidden ** -0.5, hidden), np.zeros(1)]

    def _hidden(self, rows):
        import numpy as np

        scaled = np.clip((rows - self.center) / self.scale, -8, 8)
        return scaled, np.tanh(scaled @ self.weights[0] + self.weights[1])

    def margin(self, rows):
        return self._hidden(rows)[1] @ self.weights[2] + self.weights[3]

    def fit(self, rows, slope, steps: int = STEPS, rate: float = RATE, decay: float = 1e-4):
        """`slope(margins)` gives the derivative of the risk by each row's margin. Adam on full batches."""
        import numpy as np

        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            scaled, hidden = self._hidden(rows)
            out = slope(hidden @ self.weights[2] + self.weights[3])
            back = np.outer(out, self.weights[2]) * (1 - hidden ** 2)
            gradients = [scaled.T @ back, back.sum(axis=0), hidden.T @ out, np.array([out.sum()])]
            for i, g in enumerate(gradients):
                g = g + decay * self.weights[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.weights[i] = self.weights[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(positive, unlabelled) -> float:
    """Share of positives among the unlabelled: the smallest ratio of tail shares, with a margin for their sampling error."""
    import numpy as np

    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    if not half_p or not half_u:
        return 0.5
    rows = np.concatenate((positive[:half_p], unlabelled[:half_u]))
    truth = np.concatenate((np.ones(half_p), np.zeros(half_u)))
    share = np.concatenate((np.full(half_p, 0.5 / half_p), np.full(half_u, 0.5 / half_u)))
    model = Network(rows).fit(rows, lambda m: (_sigmoid(m) - truth) * share, steps=200)
    p, u = np.sort(model.margin(positive[half_p:])), np.sort(model.margin(unlabelled[half_u:]))
    at = np.quantile(p, np.linspace(0.0, 0.9, 91))
    tail_p, tail_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(1 / len(p)) + np.sqrt(1 / len(u))
    upper = (tail_u + slack) / np.maximum(tail_p, 1e-9)
    best = int(np.argmin(upper))
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def non_negative_slope(n_positive: int, n_unlabelled: int, prior: float):
    """Derivative of the non-negative risk under the logistic loss; rows are the positives, then the unlabelled."""
    import numpy as np

    def slope(margins):
        p, u = margins[:n_positive], margins[n_positive:]
        as_positive = -_sigmoid(-p) / n_positive * prior
        negative_p, negative_u = _sigmoid(p) / n_positive * prior, _sigmoid(u) / n_unlabelled
        risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        if risk >= 0:
            return np.concatenate((as_positive - negative_p, negative_u))
        return np.concatenate((negative_p, -negative_u))  # the negative part fell below zero: step back from it

    return slope


def fit_quality(positive, unlabelled) -> tuple[Network, float]:
    import numpy as np

    prior = estimate_prior(positive, unlabelled)
    rows = np.concatenate((positive, unlabelled))
    return Network(rows).fit(rows, non_negative_slope(len(positive), len(unlabelled), prior)), prior


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Rows id_ and score_. `learn_from` is a condition on `label_id_`: labels that may be used."""
    import numpy as np
    import pyarrow as pa

    rows = packed(docs).select(field_of(doc_id).alias("id_"), text_of(text).alias("text_"))
    every = stage_table(featured(rows).withColumn("draw_", F.xxhash64(F.lit("unlabelled"), "id_")), "features")
    trusted = labelled_sample(labels, doc_id, label, learn_from & (F.col("label_") == 1), sample)
    matrix = lambda df: np.array([r.features_ for r in df.select("features_").collect()], float).reshape(-1, len(FEATURES))
    marked = every.join(F.broadcast(trusted.select("label_id_")), F.col("id_") == F.col("label_id_")).orderBy(F.xxhash64("id_"), "id_").limit(sample)
    positive, unlabelled = matrix(marked), matrix(every.orderBy("draw_", "id_").limit(sample))
    model = fit_quality(positive, unlabelled)[0] if len(positive) and len(unlabelled) else None

    def run(batches):
        for batch in batches:
            if model is None:
                scores = np.zeros(batch.num_rows)
            else:
                flat = batch.column("features_").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                scores = _sigmoid(model.margin(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(scores, pa.float64())], names=["id_", "score_"])

    schema = T.StructType([every.schema["id_"], T.StructField("score_", T.DoubleType())])
    return every.select("id_", "features_").mapInArrow(run, schema)


def op1_quality(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    scored = score_quality(docs, labels, fold(F.col("label_id_"), 5) != 0)
    return scored.select(F.col("id_").alias("doc_id"), (fold(F.col("id_"), 5) == 0).alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= THRESHOLD).cast("int").alias("predicted"))
