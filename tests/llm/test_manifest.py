from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracklens.llm import manifest as M
from tracklens.llm.queries import QUERIES


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
        at >>= 1
    return out


def by_hand(rows):
    """Per row (id, group, leaf, path): leaf digests, subroot, root and sides of siblings."""
    trees = defaultdict(list)
    for i, group, leaf in rows:
        trees[group].append((i is not None, i or 0, leaf, i))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    levels = {g: climb([m[2] for m in sorted(trees[g], key=lambda m: m[:3])]) for g in order}
    above = climb([levels[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, m in enumerate(sorted(trees[g], key=lambda m: m[:3])):
            out.append((m[3], m[2], levels[g][-1][0], above[-1][0], path(levels[g], at) + path(above, k)))
    return out


def rows_of(manifest):
    made = M.proofs(manifest).select("id_", F.lower(F.hex("node_")).alias("leaf"), "subroot_", "path_").collect()
    return sorted(((r.id_, r.leaf, r.subroot_, manifest.root, tuple(r.path_)) for r in made), key=str)


def told(rows):
    return sorted(((i, leaf, sub, root, tuple(("<" if left else ">") + s if s else "" for left, s in p)) for i, leaf, sub, root, p in rows), key=str)


@pytest.mark.parametrize("sizes", [[2, 1], [64, 65, 63, 1, 1], [4097, 1, 130]])
def test_equals_a_whole_tree(spark, sizes):
    rows = [(i, f"g{k}" if k else None, f"t{i}") for k, n in enumerate(sizes) for i in range(k * 10_000, k * 10_000 + n)]
    docs = spark.createDataFrame([(i, g, t) for i, g, t in rows], "doc_id long, lang string, text string")
    made = M.build_manifest(docs, fields=("doc_id", "text"))
    assert rows_of(made) == told(by_hand([(i, g, H(field(i), field(t))) for i, g, t in rows]))
    assert [level.count() for level in made.levels[1:]] == [sum(-(-n // 64 ** j) for n in sizes) for j in range(1, len(made.levels))]


def test_odd_rows(spark, odd):
    leaves = [(r.doc_id, r.lang, H(*[field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)])) for r in odd.collect()]
    assert rows_of(M.build_manifest(odd)) == told(by_hand(leaves))
    clash = odd.select("*", *[F.lit(1).alias(c) for c in ("tree_", "at_", "node_", "group_", "one_", "claim_")])
    assert rows_of(M.build_manifest(clash)) == told(by_hand(leaves))


def test_empty_table(spark, odd):
    made = M.build_manifest(odd.limit(0))
    assert made.root is None and M.proofs(made).count() == 0


def test_partitions_and_claims_do_not_change_the_root(spark, documents):
    plain = M.build_manifest(documents)
    claimed = M.build_manifest(documents.repartition(5), claimed={"text": F.when(F.col("doc_id") % 3 == 0, F.lit("other")).otherwise(F.col("text"))})
    assert plain.root == claimed.root
    rows = M.proofs(claimed).select("id_", M.folded(F.coalesce("claim_", "node_"), F.col("path_")).alias("root")).collect()
    assert all((r.root == plain.root) == (r.id_ % 3 != 0) for r in rows)


def test_any_changed_row_changes_the_root(spark, documents):
    changed = documents.withColumn("n_chars", F.when(F.col("doc_id") == 17, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    assert M.build_manifest(documents).root != M.build_manifest(changed).root


def test_query_rejects_exactly_the_tampered_rows(spark, small):
    import zlib

    rows = QUERIES["op12_manifest"](spark, small).collect()
    assert len({r.root for r in rows}) == 1
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
