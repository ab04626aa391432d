"""Exact deduplication against plain grouping."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tracklens.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out[(i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest())] += 1
            first = first and i != keep
    return out


def largest(rows):
    out = {}
    for r in rows:
        text = r.text or ""
        out[text] = max((i for i in (out.get(text), r.doc_id) if i is not None), default=None)
    return out


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_FILTER_BYTES, 0])
def test_marks_equal_grouping(documents, odd, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_FILTER_BYTES", limit)
    for docs in (documents, odd, odd.limit(0)):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.mark_duplicates(docs).collect())
        assert got == expected(docs.collect())


def test_drop_keeps_one_row_of_each_text(documents, odd):
    for docs in (documents, odd, odd.limit(0)):
        got = exact_dedup.drop_duplicates(docs)
        assert got.schema.names == docs.schema.names
        assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((keep, text) for text, keep in largest(docs.collect()).items())


def test_filter_misses_no_repeated_hash(spark):
    rows = spark.range(20000).selectExpr("id % 15000 AS k").selectExpr("xxhash64(k) AS hash_", "k")
    blocks, size = exact_dedup.repeated_filter(rows, 20000)
    flagged = exact_dedup.flag_repeated(rows, blocks, size, 20000)
    assert flagged.filter("k < 5000 AND NOT maybe_").count() == 0
    assert flagged.filter("k >= 5000 AND maybe_").count() < 10000 * 0.1
