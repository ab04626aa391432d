"""Contamination against every window written out."""

import hashlib
import re

import pytest

from tracklens.llm import decontamination as dc
from tracklens.llm.common import table


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items):
    windows = {}
    for item in items:
        w = words(item.text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item.item_id))
    out = []
    for doc in docs:
        w, hit, found = words(doc.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((str(doc.doc_id), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [dc.BROADCAST_ANCHORS, 0])
def test_every_window_is_found(spark, small, documents, odd, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ANCHORS", limit)
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    more = [(9001, f"x y {passage} z"), (9002, passage[6:]), (9003, "Stand alone, item!"), (9004, "so: STAND ALONE item " * 3), (9005, " ".join(passage.split()[:12])), (9006, passage + " " + passage)]
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = table(spark, small, "benchmark", "item_id", "text").unionByName(spark.createDataFrame([(70, passage), (71, "stand alone item"), (72, None), (73, passage), (74, "")], "item_id long, text string"))
    want = by_hand(docs.collect(), items.collect())
    got = sorted((str(r.doc_id), *r[1:]) for r in dc.contamination(docs, items).collect())
    assert got == want and any(r[5] for r in want)
    if limit:
        kept = dc.drop_contaminated(docs, items)
        assert kept.schema.names == docs.schema.names and kept.count() == sum(not r[5] for r in want)
        assert dc.contamination(docs.limit(0), items).count() == 0 and dc.contamination(odd, items.limit(0)).filter("n_hit > 0").count() == 0


def test_one_window_in_very_many_items(spark):
    """The items of a window set are looked up once, not once for each document and window."""
    line = "this work is free to use and to share under the same terms as it is"
    items = spark.range(100_000).selectExpr("id AS item_id", f"'{line}' AS text")
    docs = spark.range(2_000).selectExpr("id AS doc_id", f"concat('start ', id % 3, ' {line} {line} end') AS text")
    rows = dc.contamination(docs, items).select("n_hit", "n_items", "items_sha256").distinct().collect()
    want = hashlib.sha256(",".join(sorted(str(i) for i in range(100_000))).encode()).hexdigest()
    assert [tuple(r) for r in rows] == [(32, 100_000, want)]


def test_minima_by_doubling(spark):
    from pyspark.sql import functions as F

    values = [5, 3, 9, -2, 7, 7, 1, 8, 0, 4, 6]
    df = spark.createDataFrame([(values,)], "v array<long>")
    for span in range(1, 12):
        got = df.select(dc._minima(F.col("v"), span).alias("m")).first().m[: len(values) - span + 1]
        assert got == [min(values[i:i + span]) for i in range(len(values) - span + 1)]
