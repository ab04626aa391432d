"""SimHash near-duplicates with a forest of vantage-point trees.

Fingerprints of unrelated texts lie about 32 bits apart, give or take 4. With a link radius of 4 a single
tree over all 64 bits would send three quarters of the points to both sides of every cut. So the forest cuts the 64 bits into
`BLOCKS` blocks and grows one tree for each choice of BLOCKS - 4 of them: two linked fingerprints
differ in 4 blocks at most, so some tree's blocks have distance 0, and that tree's root sends both to one shard.
Inside a shard the tree splits by the distance to a vantage point. A branch is pruned by the triangle bound, and
points within 4 of the cut go to both sides, so every linked pair meets in some leaf, where it is compared exactly.

Shards above `SHARD` fingerprints are split by the same rule as a Spark job before they reach a task.
Equal fingerprints are one point, so exact copies never multiply. A shard reports its classes as a star, never all pairs.

Nulls: a null or empty text has no words and fingerprint zero, linked like any other. A null doc_id is never the smallest
of a class unless all are null. Repeated rows give one row each.
"""

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from tracklens.llm.common import ROW, field_of, join_on_group, packed, table, text_of, unpacked
from tracklens.llm.graph import components
from tracklens.session import stage_table

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SEED = 42
LEAF = 64
SHARD = 1 << 15
LEVELS = 12
CHUNK_WORDS = 1 << 16
SPACE = [9, 10, 11, 12, 13, 32]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles: a bit is set if it is set in over half of the shingles' XXH64 hashes."""
    import numpy as np
    import xxhash

    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    if not data:
        return 0
    blank = np.isin(np.frombuffer(data, np.uint8), SPACE)
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    words = len(starts)
    if not words:
        return 0
    size, counts = min(shingle, words), np.zeros(64, np.int64)
    total = words - size + 1
    hash_, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, total, CHUNK_WORDS):
        until = min(at + CHUNK_WORDS, total)
        part = data[starts[at]:ends[until + size - 2]].split()
        ends_ = np.cumsum([len(w) + 1 for w in part]) - 1
        begins = np.concatenate(([0], ends_[:-1] + 1))
        joined = b" ".join(part)
        hashes = np.array([hash_(joined[a:b], seed) for a, b in zip(begins[: until - at].tolist(), ends_[size - 1:].tolist())], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Replace the string column `text_` by its fingerprint `fp_` as a signed long; other columns stay."""
    import pyarrow as pa

    from pyspark.sql import types as T

    at = df.columns.index("text_")
    schema = T.StructType([T.StructField("fp_", T.LongType()) if f.name == "text_" else f for f in df.schema.fields])

    def run(batches):
        for batch in batches:
            signed = [fp - (1 << 64) if fp >> 63 else fp for fp in (fingerprint(t.as_py(), shingle) for t in batch.column(at))]
            yield batch.set_column(at, "fp_", pa.array(signed, pa.int64()))

    return df.mapInArrow(run, schema)


def _masks(radius: int) -> list[int]:
    """Bit masks of the forest's trees: each choice of blocks that 'radius' changed bits can leave untouched."""
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(BLOCKS)]
    masks = [sum(chosen) for chosen in combinations(blocks, BLOCKS - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def classes(points, radius: int = RADIUS, leaf: int = LEAF):
    """Class label (smallest index) of each of the distinct 64-bit points under links within the radius, by a vantage-point tree."""
    import numpy as np

    label = np.arange(len(points))

    def merge(members):
        found = np.unique(label[members])
        if len(found) > 1:
            label[np.isin(label, found[1:])] = found[0]

    def compare(members):
        mine = points[members]
        for i in range(len(members) - 1):
            near = np.flatnonzero(np.bitwise_count(mine[i + 1:] ^ mine[i]) <= radius)
            if len(near):
                merge(np.concatenate(([members[i]], members[near + i + 1])))

    waiting = [np.arange(len(points))]
    while waiting:
        members = waiting.pop()
        if len(members) <= leaf:
            compare(members)
            continue
        vantage = members[len(members) // 2]
        distance = np.bitwise_count(points[members] ^ points[vantage]).astype(np.int64)
        near = members[distance <= radius]
        merge(near)
        # The vantage point is linked to all its neighbours now, so only the other points go on.
        rest, distance = members[members != vantage], distance[members != vantage]
        if len(near) == len(members):
            continue  # all are within the radius of the vantage point: one class
        cut = int(np.median(distance))
        inner, outer = rest[distance <= cut + radius], rest[distance > cut]
        if max(len(inner), len(outer)) > 0.9 * len(members):
            compare(rest)  # the bound prunes nothing here
        else:
            waiting += [x for x in (inner, outer) if len(x) > 1]
    return label


def _shard_edges(keys, points, radius: int):
    """Star edges of the classes inside whole shards; both arrays are sorted by key."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    edges = [(points[:0], points[:0])]
    small = np.repeat((sizes > 1) & (sizes <= LEAF), sizes)
    index = np.flatnonzero(small)
    left, right, step = [], [], 0
    while len(index):
        step += 1
        index = index[index + step < len(keys)]
        index = index[keys[index] == keys[np.minimum(index + step, len(keys) - 1)]]
        near = index[np.bitwise_count(points[index] ^ points[index + step]) <= radius]
        left.append(near)
        right.append(near + step)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        label = np.arange(len(keys))
        while len(a):
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        moved = np.flatnonzero(label != np.arange(len(keys)))
        edges.append((points[moved], points[label[moved]]))
    for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        mine = points[s:s + n]
        label = classes(mine, radius)
        moved = np.flatnonzero(label != np.arange(n))
        edges.append((mine[moved], mine[label[moved]]))
    return tuple(np.concatenate(side) for side in zip(*edges))


def _split_large(shards: DataFrame, radius: int, limit: int) -> DataFrame:
    """Cut shards above the limit at the median distance to a vantage point of their own, with both sides holding the boundary.

    A shard all of whose points are within the radius of its vantage point stays: its task joins it in one step. So does
    one that a cut would not make smaller.
    """
    for level in range(LEVELS):
        counts = stage_table(shards.groupBy("key_").agg(F.count(F.lit(1)).alias("n_"), F.min_by("fp_", F.xxhash64(F.lit(level), "fp_")).alias("vantage_")).filter(F.col("n_") > limit), "large")
        if counts.isEmpty():
            break
        total = shards.count()
        aimed = join_on_group(shards, counts, "key_", "n_", ["vantage_", "n_"], total, ["fp_"])
        far = aimed.withColumn("distance_", F.when(F.col("vantage_").isNotNull(), F.bit_count(F.col("fp_").bitwiseXOR(F.col("vantage_")))))
        histogram = far.filter("distance_ IS NOT NULL").groupBy("key_", "distance_").agg(F.count(F.lit(1)).alias("c_"), F.max("n_").alias("n_"))
        run = histogram.withColumn("run_", F.sum("c_").over(Window.partitionBy("key_").orderBy("distance_")))
        cuts = run.groupBy("key_").agg(F.min(F.when(F.col("run_") * 2 >= F.col("n_"), F.col("distance_"))).alias("cut_"), F.max("n_").alias("n_"), F.collect_list(F.struct("distance_", "c_")).alias("all_"))
        inner = F.aggregate("all_", F.lit(0).cast("long"), lambda a, x: a + F.when(x["distance_"] <= F.col("cut_") + radius, x["c_"]).otherwise(0))
        outer = F.aggregate("all_", F.lit(0).cast("long"), lambda a, x: a + F.when(x["distance_"] > F.col("cut_"), x["c_"]).otherwise(0))
        useful = stage_table(cuts.filter(F.greatest(inner, outer) * 10 < F.col("n_") * 9).select("key_", "cut_", F.col("n_")), "cuts")
        if useful.isEmpty():
            break
        cut = join_on_group(far.select("key_", "fp_", "distance_"), useful, "key_", "n_", ["cut_"], total, ["fp_"])
        sides = F.when(F.col("cut_").isNull(), F.array("key_")).otherwise(F.array_compact(F.array(
            F.when(F.col("distance_") <= F.col("cut_") + radius, F.xxhash64("key_", F.lit(level), F.lit("inner"))),
            F.when(F.col("distance_") > F.col("cut_"), F.xxhash64("key_", F.lit(level), F.lit("outer"))),
        )))
        shards = stage_table(cut.select(F.explode(sides).alias("key_"), "fp_"), "shards")
    return shards


def link_edges(points: DataFrame, radius: int = RADIUS, limit: int = SHARD) -> DataFrame:
    """Edges a_, b_ that connect the distinct fingerprints `fp_` exactly as all links within the radius do."""
    import numpy as np
    import pyarrow as pa

    keys = [F.xxhash64(F.lit(tree), F.col("fp_").bitwiseAND(F.lit(mask))) for tree, mask in enumerate(_masks(radius))]
    shards = points.select(F.explode(F.array(*keys)).alias("key_"), "fp_")
    shards = _split_large(shards, radius, limit)

    def run(batches):
        held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            held_keys = np.concatenate((held_keys, batch.column("key_").to_numpy(zero_copy_only=False)))
            held = np.concatenate((held, batch.column("fp_").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            if not len(held_keys):
                continue
            whole = int(np.searchsorted(held_keys, held_keys[-1]))  # the last shard may go on in the next batch
            yield made(held_keys[:whole], held[:whole])
            held_keys, held = held_keys[whole:], held[whole:]
        yield made(held_keys, held)

    def made(keys_, points_):
        a, b = _shard_edges(keys_, points_, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a_", "b_"])

    return shards.repartition("key_").sortWithinPartitions("key_").mapInArrow(run, "a_ long, b_ long")


def _classed(prints: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """Staged rows (`id_`, `fp_`, ...) with `component_`: the smallest id reachable over links."""
    total = prints.count()
    points = stage_table(prints.groupBy("fp_").agg(F.min("id_").alias("least_"), F.count(F.lit(1)).alias("n_")), "points")
    roots = stage_table(components(link_edges(points.select("fp_"), radius)), "roots")
    rooted = stage_table(points.join(roots, F.col("fp_") == F.col("node_"), "left").select("fp_", "least_", "n_", F.coalesce("root_", "fp_").alias("root_")), "rooted")
    smallest = stage_table(rooted.groupBy("root_").agg(F.min("least_").alias("component_"), F.count(F.lit(1)).alias("points_")), "smallest")
    named = stage_table(join_on_group(rooted, smallest, "root_", "points_", ["component_"], rooted.count(), ["fp_"]), "named")
    return join_on_group(prints, named, "fp_", "n_", ["component_", "root_"], total, ["id_"]), total


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    rows = packed(docs).select(field_of(doc_id).alias("id_"), text_of(text).alias("text_"))
    prints = stage_table(fingerprints(rows, shingle), "prints")
    joined, _ = _classed(prints, radius)
    return joined.select(F.col("id_").alias("doc_id"), F.lower(F.lpad(F.hex("fp_"), 16, "0")).alias("fingerprint"), F.col("component_").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with all their columns, but of each group of linked ones only the row with the smallest doc_id.

    Texts are read twice and never shuffled unless the list of rows to drop is large: rows are dropped by doc_id and digest of the text.
    """
    base = packed(docs).select(field_of(doc_id).alias("id_"), F.xxhash64(F.col(ROW)).alias("mark_"), text_of(text).alias("text_"))
    prints = stage_table(fingerprints(base, shingle), "prints")
    joined, _ = _classed(prints, radius)
    keys = stage_table(joined.select("id_", "mark_", "root_"), "keys")
    first = keys.groupBy("root_").agg(F.min(F.struct(F.col("id_").isNull().alias("none_"), "id_", "mark_")).alias("first_"))
    keep = stage_table(first.select(F.col("first_.id_").alias("keep_id_"), F.col("first_.mark_").alias("keep_mark_")), "keep")
    marked = packed(docs).withColumn("mark_", F.xxhash64(F.col(ROW)))
    left = marked.join(keep, field_of(doc_id).eqNullSafe(F.col("keep_id_")) & (F.col("mark_") == F.col("keep_mark_")), "left_semi")
    return left.dropDuplicates(["mark_"]).select(*unpacked(left, docs)) if _repeats(keys) else left.select(*unpacked(left, docs))


def _repeats(keys: DataFrame) -> bool:
    """True if some row occurs twice in all columns."""
    return not keys.groupBy("id_", "mark_").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").isEmpty()


def op4_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
