"""Rows that the near-duplicate stage makes for crowds of texts that share passages."""

import random

from tracklens.llm import similar
from test_similar import kept_by_hand


def crowd(draw, n, own, passage, changed):
    """`n` texts of a shared passage with some changed words, and words of their own."""
    word = lambda: f"w{draw.randrange(10 ** 6)}"
    common = [word() for _ in range(passage)]
    for _ in range(n):
        text = list(common)
        for _ in range(changed):
            text[draw.randrange(len(text))] = word()
        yield " ".join(text + [word() for _ in range(own)])


def made(spark, monkeypatch, texts):
    counts, stage = {}, similar.stage_table
    def counted(df, name):
        table = stage(df, name)
        counts.setdefault(name, table.count())
        return table
    monkeypatch.setattr(similar, "stage_table", counted)
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == kept_by_hand(rows)
    return counts


def test_texts_of_a_shared_passage_make_no_pair_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", 1)  # no shingle is known as frequent
    counts = made(spark, monkeypatch, list(crowd(random.Random(2), 80, 50, 60, 0)))
    assert counts["rest"] == 0


def test_a_crowd_of_near_copies_meets_two_shorter_texts_each(spark, monkeypatch):
    counts = made(spark, monkeypatch, list(crowd(random.Random(5), 80, 0, 300, 6)))
    assert counts["stars"] <= 80 * 2 + counts["candidates"]


def test_shingles_held_by_the_same_texts_are_one_group(spark, monkeypatch):
    """Families of two texts of which a third is shared have many prefix shingles in common and are one group each."""
    monkeypatch.setattr(similar, "SAMPLE", 1)
    draw = random.Random(9)
    counts = made(spark, monkeypatch, [t for _ in range(6) for t in crowd(draw, 2, 40, 400, 8)])
    assert 0 < counts["shared"] <= 6 * 2


def test_a_crowd_about_the_bound_is_joined_by_nearest_partners(spark, monkeypatch):
    """Most pairs lie close to the bound on either side; they become rows only where components stay apart."""
    counts = made(spark, monkeypatch, list(crowd(random.Random(7), 90, 0, 300, 4)))
    assert counts["rest"] <= 90
