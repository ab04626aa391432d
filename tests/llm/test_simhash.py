"""SimHash fingerprints, links and classes against definitions written out."""

import re

import numpy as np
import xxhash

from tracklens.llm import simhash
from tracklens.llm.graph import components


def by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(points):
    near, label = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4, np.arange(len(points))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def clustered(random, groups, copies):
    base = random.integers(0, 2**63, groups, dtype=np.uint64)
    flip = lambda: np.uint64(1) << random.integers(0, 64, groups).astype(np.uint64)
    return np.unique(np.concatenate([base] + [base ^ flip() ^ flip() for _ in range(copies)]))


def test_fingerprint(monkeypatch, documents):
    texts = [r.text for r in documents.limit(40).collect()] + ["", " \t", "a", "A b", "a b c d", "É a\x0bB\xa0c d  e\n"]
    for words in (1 << 16, 7):
        monkeypatch.setattr(simhash, "CHUNK_WORDS", words)
        assert [simhash.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]


def test_tree_finds_every_class():
    random = np.random.default_rng(5)
    for _ in range(25):
        points = clustered(random, int(random.integers(1, 40)), int(random.integers(1, 30)))
        assert (simhash.classes(points, leaf=4) == linked(points)).all()


def test_split_shards_lose_no_link(spark):
    points = clustered(np.random.default_rng(9), 40, 12)
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp_ long")
    groups = lambda df: {r.node_: r.root_ for r in components(df).collect()}
    label = linked(points)
    smallest = {n: int(points.view(np.int64)[label == n].min()) for n in set(label)}
    want = {int(p): smallest[n] for p, n in zip(points.view(np.int64), label) if int(p) != smallest[n]}
    assert groups(simhash.link_edges(frame, limit=8)) == want


def test_components_and_odd_rows(documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    rows = docs.collect()
    prints = [by_hand(r.text) for r in rows]
    label = linked(np.array(prints, np.uint64))
    least = {n: min((rows[i].doc_id for i in np.flatnonzero(label == n) if rows[i].doc_id is not None), default=None) for n in set(label)}
    want = sorted((str(r.doc_id), f"{p:016x}", str(least[n])) for r, p, n in zip(rows, prints, label))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(label)) and {str(r.doc_id) for r in kept} >= {str(v) for v in least.values()}


def test_empty_table(odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
