import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracklens.llm import fill_middle as M


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def checked(df):
    made = M.fill_in_middle(df)
    source = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    back = made.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, *by_hand(r.doc_id, r.text)) for r in df.collect()), key=str) == sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=str)
    assert sorted(((r.doc_id, r.back) for r in back), key=str) == sorted(((i, t or "") for i, t in source), key=str)
    return back


def test_documents_equal_the_definition_and_come_back(documents):
    assert {r.form for r in checked(documents)} == {"plain", "psm", "spm"}


def test_odd_rows_clashing_names_and_empty_tables(spark, odd):
    clash = odd.select("*", *[F.lit("x").alias(c) for c in ("n", "output", "form_", "text_", "kept_", "odd name's")])
    assert len(checked(odd)) == odd.count()
    made = M.fill_in_middle(clash)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "row_", "form_", "text_", "kept_", "odd name's", *M.ADDED] and made.count() == odd.count()
    assert M.fill_in_middle(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bytes_", [1, 40, 1 << 30])
def test_slices_do_not_matter(spark, monkeypatch, bytes_):
    texts = ["", "a", "<P> in it", "x<P", "<", "é漢字😀 mixed  \n\t words", "ab12cd!!", "\x00nul\x7f", "ÿ\u0080￿", "<S<M<P>>", ">S<" * 9, None] * 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(M, "SLICE_BYTES", bytes_)
    checked(docs)


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(i, "word, 漢 " * 200_000) for i in range(3)], "doc_id long, text string")
    checked(docs)
