"""Merkle manifest of a dataset by checkpoint and recompute.

Every row is a leaf, every tree (the rows of one group) orders its leaves, two neighbours hash to their parent, and a tree over the groups' roots
gives the dataset's root. Of the levels only every `BAND`-th is stored (leaves, level 6, level 12, ...), which is a 63rd more than the
leaves. A proof needs the levels between: nodes of a stored level are collected by aligned subtrees of 2^BAND, a task regenerates the subtree's interior,
emits each node's siblings below the siblings of the subtree's root, and forgets the interior. Proofs go from the root down,
one band a step, so a row never meets more than its own subtree.

Places in a tree come from one global order by group, id and leaf, summed range by range, so no group, however large, is one task. A group
with a single row is its own root.

Digests are SHA-256 of concatenated hexadecimal digests. A leaf hashes its fields, each `-` if null, else byte count, `:`, value.
Rows of equal id are ordered by their leaves; equal rows take neighbouring places. A null group comes first, other groups by bytes; a null id comes
first in its group. An empty table has no rows and no root.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import field_of, join_on_group, packed, ranged_running_sum, scalar, table
from tracklens.llm.sharding import CRC_TABLE_SQL, crc_sql
from tracklens.session import stage_table

BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def halved(nodes: list[bytes]) -> list[bytes]:
    """Parents of neighbouring nodes, as hexadecimal digests; a last node without a neighbour has a parent of its own."""
    return [sha256(b"".join(nodes[i:i + 2])).hexdigest().encode() for i in range(0, len(nodes), 2)]


def interior(nodes: list[bytes], steps: int) -> list[list[bytes]]:
    """The subtree's levels from its stored nodes upwards."""
    levels = [nodes]
    for _ in range(steps):
        levels.append(halved(levels[-1]))
    return levels


def _steps(leaves: int, level: int) -> int:
    """Levels of a tree with so many leaves that lie above the given one, at most a band."""
    return max(0, min(BAND, (leaves - 1).bit_length() - level))


@dataclass
class Manifest:
    """Stored levels of the group trees (leaves first, roots last) and of the tree over the groups' roots."""

    levels: list[DataFrame]
    groups: list[DataFrame]
    root: str | None


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """One row for each aligned subtree of a stored level: its nodes in order, 2^BAND at most."""
    return nodes.groupBy("tree_", F.shiftright("at_", BAND).alias("block_")).agg(
        F.first("n_").alias("n_"), F.array_sort(F.collect_list(F.struct("at_", "node_", *more))).alias("nodes_")
    )


def _hexed(batch) -> tuple[list[bytes], list[int]]:
    """All nodes of a batch of subtrees as hexadecimal digests, and where each subtree's nodes start."""
    lists = batch.column("nodes_")
    return [node.hex().encode() for node in lists.flatten().field("node_").to_pylist()], lists.value_lengths().to_pylist()


def _tops(blocks: DataFrame, level: int) -> DataFrame:
    """The root of each subtree, a node of the next stored level."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            nodes, lengths = _hexed(batch)
            tops, start = [], 0
            for length, n in zip(lengths, batch.column("n_").to_pylist()):
                tops.append(bytes.fromhex(interior(nodes[start:start + length], _steps(n, level))[-1][0].decode()))
                start += length
            yield pa.RecordBatch.from_arrays([batch.column("tree_"), batch.column("block_"), batch.column("n_"), pa.array(tops, pa.binary())], names=["tree_", "at_", "n_", "node_"])

    return blocks.mapInArrow(run, "tree_ long, at_ long, n_ long, node_ binary")


def _stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """Stored levels over staged leaves tree_, at_, n_, node_; the last has one node for each tree. A finished tree is carried on."""
    levels = [leaves]
    while (scalar(levels[-1].agg(F.max("at_")))[0] or 0) > 0:
        level = BAND * (len(levels) - 1)
        levels.append(stage_table(_tops(_blocks(levels[-1].select("tree_", "at_", "n_", "node_")), level), f"level{level + BAND}"))
    return levels


def _placed_in(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Staged rows with tree_ (places before the group's first), at_ (place in the group) and n_ (its rows); and the groups."""
    running = ranged_running_sum(rows.withColumn("one_", F.lit(1).cast("long")), [group, *order], ["one_"], "places").drop("one_")
    keyed = running.withColumn("key_", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    groups = stage_table(keyed.groupBy("key_").agg((F.min("run_one_") - 1).alias("tree_"), F.count(F.lit(1)).alias("n_")), "groups")
    total = scalar(groups.agg(F.sum("n_")))[0] or 0
    joined = join_on_group(keyed, groups, "key_", "n_", ["tree_", "n_"], total, ["run_one_"])
    return stage_table(joined.withColumn("at_", F.col("run_one_") - 1 - F.col("tree_")).drop("run_one_", "key_", group), "leaves"), groups


def build_manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id", claimed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. `claimed` replaces fields of the rows to be verified, by expressions on the caller's columns: their leaf is
    kept beside the true one, to be folded along the true siblings."""
    base = packed(docs)
    true = leaf_of(*[field_of(name) for name in fields])
    claim = F.lit(None).cast("binary")
    if claimed:
        named = docs.select("*", *[value.alias(f"claimed_{name}_") for name, value in claimed.items()])
        base = packed(named)
        changed = F.lit(False)
        for name in claimed:
            changed = changed | ~field_of(f"claimed_{name}_").eqNullSafe(field_of(name))
        claim = F.when(changed, leaf_of(*[field_of(f"claimed_{name}_" if name in claimed else name) for name in fields]))
    rows = stage_table(base.select(field_of(group).alias("group_"), field_of(order).alias("id_"), true.alias("node_"), claim.alias("claim_")), "hashed")
    leaves, groups = _placed_in(rows, "group_", ["id_", "node_"])
    levels = _stored_levels(leaves)
    # The groups' places before their first rows order them as the global order does: null first, then by bytes.
    roots = levels[-1].select(F.lit(0).cast("long").alias("all_"), F.col("tree_").alias("own_"), "node_")
    tops, _ = _placed_in(roots, "all_", ["own_"])
    above = _stored_levels(tops)
    last = scalar(above[-1].select(F.lower(F.hex("node_")))) if above else None
    return Manifest(levels, above, last[0] if last else None)


def _descended(levels: list[DataFrame], upper: DataFrame, more: list[str]) -> DataFrame:
    """Path of each leaf to the root, with the leaves' columns `more`: `upper` has tree_ and the path_ of each tree's root.

    A path lists one entry for each level, `<` or `>` for a left or right sibling and its digest, or nothing for a node alone.
    """
    paths = upper.withColumn("at_", F.lit(0).cast("long"))
    for number in range(len(levels) - 2, -1, -1):
        kept = more if number == 0 else []
        blocks = _blocks(levels[number], *kept)
        above = paths.select(F.col("tree_").alias("up_tree_"), F.col("at_").alias("up_at_"), "path_")
        joined = blocks.join(above, (F.col("tree_") == F.col("up_tree_")) & (F.col("block_") == F.col("up_at_")))
        paths = _siblings(joined, BAND * number, levels[number], kept)
        if number:
            paths = stage_table(paths, "paths")
    if len(levels) == 1:
        return levels[0].select("tree_", "at_", "node_", *more).join(upper, "tree_")
    return paths


def _siblings(blocks: DataFrame, level: int, nodes: DataFrame, more: list[str]) -> DataFrame:
    """One row for each stored node of the subtrees: the siblings inside its subtree, then the path of the subtree's root."""
    import numpy as np
    import pyarrow as pa

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("tree_", T.LongType()), *[nodes.schema[name] for name in ("at_", "node_", *more)], T.StructField("path_", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            hexed, lengths = _hexed(batch)
            held = batch.column("nodes_").flatten()
            out, start = [], 0
            for length, n, upper in zip(lengths, batch.column("n_").to_pylist(), batch.column("path_").to_pylist()):
                levels = interior(hexed[start:start + length], _steps(n, level))
                for place in range(length):
                    own = []
                    for nodes_ in levels[:-1]:
                        beside = place ^ 1
                        own.append(("<" if place & 1 else ">") + nodes_[beside].decode() if beside < len(nodes_) else "")
                        place >>= 1
                    out.append(own + upper)
                start += length
            tree = np.repeat(batch.column("tree_").to_numpy(zero_copy_only=False), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), *[held.field(name) for name in ("at_", "node_", *more)], pa.array(out, pa.list_(pa.string()))], schema=None, names=schema.names)

    return blocks.mapInArrow(run, schema)


def proofs(manifest: Manifest) -> DataFrame:
    """One row for each leaf: id_, node_ (leaf), claim_, subroot_ (hexadecimal) and path_ to the dataset's root."""
    none = F.array().cast("array<string>")
    top = _descended(manifest.groups, manifest.groups[-1].select("tree_", none.alias("path_")), ["own_"])
    upper = stage_table(top.select(F.col("own_").alias("tree_"), "path_"), "upper")
    subroots = manifest.levels[-1].select(F.col("tree_").alias("root_tree_"), F.lower(F.hex("node_")).alias("subroot_"))
    found = _descended(manifest.levels, upper, ["id_", "claim_"])
    return found.join(subroots, F.col("tree_") == F.col("root_tree_")).select("id_", "node_", "claim_", "subroot_", "path_")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (bytes) gives along a path."""
    digest = lambda entry: F.substring(entry, 2, 64)
    return F.aggregate(
        path, F.lower(F.hex(leaf)),
        lambda node, entry: F.when(entry.startswith("<"), F.sha2(F.concat(digest(entry), node), 256)).otherwise(F.sha2(F.concat(node, digest(entry)), 256)),
    )


def op12_manifest(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    manifest = build_manifest(docs, claimed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    siblings = F.array_join(F.transform("path_", lambda entry: F.substring(entry, 2, 64)), "")
    root = F.lit(manifest.root).cast("string")
    made = proofs(manifest).select(
        F.col("id_").alias("doc_id"), F.lower(F.hex("node_")).alias("leaf"), F.col("subroot_").alias("subroot"), root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("claim_", "node_"), F.col("path_")).alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _encoded_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP12_SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS f FROM documents, e),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS at, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM d)),
p AS (SELECT d.*, g.at AS tree, g.k, row_number() OVER (PARTITION BY g.at ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g.at) AS n FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
t AS (SELECT tree, 0 AS lvl, pos, leaf AS node, n FROM p UNION ALL
 SELECT tree, lvl + 1, pos // 2, sha256(node || coalesce(after, '')), (n + 1) // 2 FROM (SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY pos) AS after FROM t WHERE n > 1) WHERE pos % 2 = 0),
s AS (SELECT tree, node FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, tree AS pos, node, (SELECT count(*) FROM s) AS n FROM s UNION ALL
 SELECT lvl + 1, pos // 2, sha256(node || coalesce(after, '')), (n + 1) // 2 FROM (SELECT *, lead(node) OVER (ORDER BY pos) AS after FROM u WHERE n > 1) WHERE pos % 2 = 0),
w AS (SELECT doc_id, leaf, tree, k, 0 AS lvl, pos, n, f, '' AS proof FROM p UNION ALL
 SELECT w.doc_id, w.leaf, w.tree, w.k, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, CASE WHEN w.pos % 2 = 1 THEN sha256(t.node || w.f) ELSE sha256(w.f || coalesce(t.node, '')) END, w.proof || coalesce(t.node, '')
 FROM w LEFT JOIN t ON t.tree = w.tree AND t.lvl = w.lvl AND t.pos = xor(w.pos, 1) WHERE w.n > 1),
x AS (SELECT doc_id, leaf, tree, 0 AS lvl, tree AS pos, k AS n, f, proof FROM w WHERE n = 1 UNION ALL
 SELECT x.doc_id, x.leaf, x.tree, x.lvl + 1, x.pos // 2, (x.n + 1) // 2, CASE WHEN x.pos % 2 = 1 THEN sha256(u.node || x.f) ELSE sha256(x.f || coalesce(u.node, '')) END, x.proof || coalesce(u.node, '')
 FROM x LEFT JOIN u ON u.lvl = x.lvl AND u.pos = xor(x.pos, 1) WHERE x.n > 1)
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.node AS verified
FROM x JOIN s ON s.tree = x.tree, (SELECT node FROM u WHERE n = 1) r WHERE x.n = 1"""
