"""The pipeline's near-duplicate stage against Jaccard similarity of all pairs."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tracklens.llm import similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(rows):
    """Smallest id of each class under 5-word Jaccard >= 4/5."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if n == label[i] else n for n in label]
    return {min(rows[i][0] for i in range(len(rows)) if label[i] == n) for n in set(label)}


def edited(draw):
    """Families of 60 to 300 words with up to 12 changed, removed or added words, chains of edits, a shared passage, short texts."""
    word = lambda: f"w{draw.randrange(3000)}"
    passage, out = [word() for _ in range(60)], ["", None, " ", "a", "A", "a b c d", "a b c d e", "a b c d e f"]
    for family in range(40):
        base = [word() for _ in range(draw.choice([60, 100, 300]))] + (passage if family % 3 == 0 else [])
        for _ in range(draw.randrange(1, 8)):
            text = list(base)
            for _ in range(draw.randrange(0, 13)):
                at = draw.randrange(len(text))
                text[at:at + draw.randrange(2)] = [word()] * draw.randrange(2)
            out.append(" ".join(text))
            base = text if family % 2 else base
    return out


def test_stage_keeps_one_of_each_similar_class(spark, small):
    rows = [(i, t) for i, t in enumerate(edited(random.Random(3)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, small).collect())
    assert got == sorted(kept_by_hand(rows)) and len(got) < len(rows)


def test_bitmaps_never_exceed_the_difference(spark):
    """Folded to one width, two bitmaps differ in no more bits than the sets in members."""
    import numpy as np

    draw = np.random.default_rng(5)
    pairs = []
    for n, m in [(1, 1), (500, 520), (512, 513), (600, 750), (1000, 1100), (4000, 4200)]:
        common = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = np.unique(common), np.unique(np.concatenate((common[: n - n // 10], draw.integers(0, 1 << 63, m - n + n // 10, dtype=np.uint64))))
        pairs.append((similar._parity(a).tolist(), similar._parity(b).tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, apart long")
    folded = df.select(similar._folded(F.col("a"), F.size("b")).alias("a"), similar._folded(F.col("b"), F.size("a")).alias("b"), "apart").collect()
    for r in folded:
        assert len(r.a) == len(r.b)
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(r.a, r.b))
        assert bits <= r.apart and (bits - r.apart) % 2 == 0


def test_given_documents_and_odd_rows(spark, documents, odd):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id for r in similar.drop_similar(documents).collect()} == kept_by_hand(rows)
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 9]
    assert similar.drop_similar(odd.limit(0)).count() == 0
    assert similar.drop_similar(odd.withColumn("text", F.lit("same"))).count() == 1
