"""Mixing against a sequential simulation of the same queue."""

from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from tracklens.llm import mixing


def by_hand(rows):
    """Targets, then a merge of each source's repeated queue by finish time, cut at the budget."""
    size = defaultdict(int)
    for r in rows:
        size[r.source] += r.n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = sum(size.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in capped)
        level = (budget - sum(3 * size[s] for s in capped)) / rest if rest else 0
        more = {s for s in names if s not in capped and weight[s] * level > 3 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * size[s] if s in capped else weight[s] * level for s in names}
    line = []
    for s in names:
        served = 0
        for repeat in range(3):
            for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.draw, r.doc_id is not None, r.doc_id or 0, r.tie)):
                served += r.n
                if target[s] > 0:
                    line.append((served / target[s], names.index(s), r.draw, r.doc_id if r.doc_id is not None else -1, repeat, r.n))
    taken, used = defaultdict(int), 0
    for item in sorted(line):
        used += item[-1]
        if used > sum(target.values()) + 1e-6:
            break
        taken[item[3]] += item[-1]
    return target, taken, size


def test_amounts(documents):
    rows = documents.select("doc_id", "source", F.regexp_count("text", F.lit(mixing.WORD)).alias("n"), F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("draw"), F.xxhash64("text").alias("tie")).collect()
    target, taken, size = by_hand(rows)
    source = {r.doc_id: r.source for r in rows}
    got = mixing.mix_amounts(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
        assert r.taken == taken[r.doc_id] and r.taken <= 3 * r.size
    again = mixing.mix_amounts(documents.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for target in {r.target for r in got}:
        mine = [r for r in got if r.target == target]
        sources = len({r.source_size for r in mine})
        assert abs(sum(r.taken for r in mine) - target * sources) <= 2 * sources * max(r.size for r in mine)


def test_mixed_sequence_is_ordered_and_whole(documents):
    rows = mixing.mix(documents).collect()
    assert [r.mix_finish for r in rows] == sorted(r.mix_finish for r in rows)
    words = sum(len((r.text or "").split()) for r in documents.collect())
    assert 0 <= words - sum(len((r.text or "").split()) for r in rows) < max(len((r.text or "").split()) for r in documents.collect())


def test_odd_rows(odd, monkeypatch):
    rows = mixing.mix(odd)
    assert rows.schema.names == odd.schema.names + ["mix_repeat", "mix_finish"] and rows.count() > 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.mix_amounts(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_amounts(odd.limit(0)).count() == 0
