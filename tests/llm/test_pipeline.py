"""The pipeline's stages against properties of their input, and registration."""

import hashlib

import corpus_pipeline
from tracklens.llm import decontamination, queries, simhash
from tracklens.llm.common import table


def test_stages(spark, small, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    got = corpus_pipeline.run(spark, small).collect()
    texts = {r.doc_id: r.text for r in got}
    assert len({hashlib.sha256(t.encode()).hexdigest() for t in texts.values()}) == len(texts)
    prints = [simhash.fingerprint(t) for t in texts.values()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    marked = {r.doc_id: r.contaminated for r in decontamination.contamination(documents, table(spark, small, "benchmark")).collect()}
    assert not any(marked[i] for i in texts)
    assert [r.mix_finish for r in got] == sorted(r.mix_finish for r in got)


def test_queries_are_registered():
    import __spark_entry__

    registered = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())
