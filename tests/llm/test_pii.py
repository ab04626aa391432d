"""Personal data against the patterns as stated, and disclosure on a small corpus."""

import hashlib
import re

from tracklens.llm import pii

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_d@e.f x", "a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1111-", "+1 (555) 555-1234 +12", "é😀 a.b@c.de 漢 10.0.0.1",
    "9" * 3000, "1 " * 3000, "a." * 3000 + "@x", "x@y.z" * 50, "+1-" * 3000, "4012888888881881 5 4012888888881882",
]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def by_hand(text):
    out = []
    for rank, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(int(p) for p in m.group().split(".")) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 10000 AS doc_id", "text").filter("doc_id IS NOT NULL").distinct())
    docs = docs.unionByName(spark.createDataFrame([(90000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        want = by_hand(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == w[2] for w in want) for k in STATED]
        assert set(listed.split(",")) <= set(r.spans.split(","))
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_revealing_term_is_generalised_everywhere(spark):
    rows = [(i, f"{w} ask bossman at boss@x.com {w}{w}") for i, w in enumerate(["one", "two", "six", "ten"])]
    rows += [(10 + i, f"common words ask here {w}") for i, w in enumerate("abcdefgh")] + [(30, "Bossman was here"), (31, None)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[30] == "[TERM] was here" and got[31] is None and got[10] == "common words ask here a"
    assert got[0] == "one ask [TERM] at [EMAIL] oneone"


def test_same_neighbourhood_in_different_texts_counts_each_time(spark):
    rows = [(i, f"note{i} about item{i} . kind regards from hammerfest hammer@x.com sent by phone") for i in range(6)]
    rows += [(10 + i, f"other text{i} about us sent by phone with kind regards from us") for i in range(20)] + [(40, "Hammerfest was here")]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[40] == "[TERM] was here" and got[10] == rows[6][1]
    assert got[0] == "note0 about item0 . kind regards from [TERM] [EMAIL] sent by phone"


def test_term_far_from_its_entity_is_found(spark):
    filler = " ".join(f"filler{chr(97 + i)}" for i in range(60))
    rows = [(i, f"Dear Hammerfest, {filler} topic{i} {filler} write to sales@x.com") for i in range(5)]
    rows += [(10 + i, f"Dear friend{i}, {filler} write to us") for i in range(40)] + [(60, "hammerfest was here")]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[60] == "[TERM] was here" and got[10] == rows[5][1]
    assert got[0] == f"Dear [TERM], {filler} topic0 {filler} write to [EMAIL]"
