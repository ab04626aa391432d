"""Near-duplicates of a pipeline stage: SimHash links from the vantage-point forest, an exact check, and an exact way for what they miss.

Texts are linked at Jaccard >= 4/5 of their word 5-shingles. Candidates come from two places:

* Fingerprints over the 5-shingles go through the forest of `simhash.py`, which gives all classes within `RADIUS` bits. At Jaccard 4/5
  fingerprints lie 10 bits apart, give or take 3, and a radius that holds nearly all of them (18) leaves a tree nothing to prune, so the
  forest finds the closer copies only.
* The rest comes from a prefix filter. Two texts with n and m >= n shingles above the bound share over m * 4/5 of them, so the first n - ceil(n * 4/5) + 1
  shingles of both, in any order that all texts have in common, share one. No link is lost, whatever the order; shingles that are frequent in a sample of
  texts come last in it, so few texts meet.

Every candidate is checked. A parity bitmap of the shingles gives a lower bound of the symmetric difference, so most pairs below 4/5 end
there; whole shingle sets are compared for the others only. A text first meets the `STARS` of the shortest texts of its groups with which it shares
most prefix shingles, which is linear; texts that are connected by then are done. Groups of a prefix shingle that hold several components come
second: bitmaps of `SKETCH_BITS` are compared in the task that holds the group, and each text goes on with the nearest one of another component only.
This is repeated while it finds links. In the end all pairs of different components that bitmaps leave possible become rows. A crowd of
texts that share prefixes but stay below the bound is compared pair by pair in the tasks. Shingles held by the same texts are one group.

Nulls: a null or empty text has no shingles and equals others of that kind; a text under five words is one shingle. Texts with equal sets
are one point, named by a 64-bit hash. A null doc_id is never the smallest of a class unless all are null. Repeated rows give one row.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracklens.llm.common import ROW, field_of, join_on_group, packed, text_of, unpacked
from tracklens.llm.exact_dedup import flag_repeated, repeated_filter
from tracklens.llm.graph import components
from tracklens.llm.simhash import link_edges
from tracklens.session import stage_table

SHINGLE = 5
SHARE, OF = 4, 5  # Jaccard >= SHARE / OF
SAMPLE = 4000
FREQUENT = 200_000
LEAST_ROWS = 50_000
CHUNK = 1 << 20
PARITY_BITS = 512  # of the narrowest bitmap
SKETCH_BITS = 1024  # of the bitmap that travels with a text's shared prefix shingles
STARS = 2


def shingle_set(text: str):
    """The distinct word shingles of a text as sorted 64-bit hashes."""
    import numpy as np

    return np.unique(shingles_of(text))


def shingles_of(text: str):
    """The word shingles of a text, repeats included, as 64-bit hashes; words and case as in `simhash.fingerprint`."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hash_ = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_(w) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = len(words) - size + 1
    out = np.full(total, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i:i + total]) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def _fingerprint(shingles) -> int:
    """SimHash of the shingles: a bit is set if it is set in over half of the hashes."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        counts += np.unpackbits(shingles[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def _parity(distinct):
    """A bit for each residue of the hashes, set if an odd number of them has it: two bitmaps differ in no more bits than the sets in members.

    The width is a power of two and at least the number of shingles; a wider bitmap folds to a narrower one.
    """
    import numpy as np

    return _odd(distinct, max(PARITY_BITS, 1 << max(len(distinct) - 1, 0).bit_length())).view(np.int64)


def _odd(distinct, width: int):
    import numpy as np

    odd = np.bincount((distinct & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def _node(shingles) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _prefix(shingles, frequent, rank):
    """The shingles that two texts above the bound cannot both miss; `frequent` is sorted, `rank` its order among all."""
    import numpy as np

    n = len(shingles)
    length = n - -(-n * SHARE // OF) + 1 if n else 0
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1) if len(frequent) else None
    if at is None:
        return shingles[:length]
    late = frequent[at] == shingles
    rare = shingles[~late]
    if len(rare) >= length:
        return rare[:length]
    return np.concatenate((rare, shingles[late][np.argsort(rank[at[late]])]))[:length]


def _hashed(df: DataFrame, schema: str, made) -> DataFrame:
    """Replace the last column `text_` by what `made` gives for its shingles."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [made(shingles_of(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            more = [pa.array(c, type_) for type_, c in zip(types, zip(*rows))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], *names])

    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = [pa.list_(pa.int64()) if k.startswith("array") else pa.binary() if k == "binary" else pa.int64() for k in kinds]
    kept = df.drop("text_").schema
    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema]))


def _signed(values):
    import numpy as np

    return values.view(np.int64)


def _frequent(texts: DataFrame):
    """Shingles that several texts of a sample hold, sorted, with their rank by count; the sample only decides how fast the joins are."""
    import numpy as np

    every = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64(F.lit("sample"), "mark_"), F.lit(every)) == 0).select("text_")
    held = _hashed(sample, "set_ array<long>", lambda s: (_signed(np.unique(s)),)).select(F.explode("set_").alias("token_"))
    counted = held.groupBy("token_").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").orderBy(F.desc("n_"), "token_").limit(FREQUENT).collect()
    tokens = np.array([r.token_ for r in counted], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = len(tokens) - np.arange(len(tokens))
    return tokens[order], rank[order]


def _by_token(rows: DataFrame, schema: str, made) -> DataFrame:
    """Apply `made` to whole groups of rows token_, size_, node_, ..., sorted by these; it yields tuples of arrays."""
    import numpy as np
    import pyarrow as pa

    names, outs = rows.columns, [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if held and piece[0][-1] == held[-1][0][-1]:
                held.append(piece)
                continue
            held.append(piece)
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on in the next batch
            yield from told(*[c[:cut] for c in whole])
            held = [[c[cut:] for c in whole]]
        if held:
            yield from told(*[np.concatenate(c) for c in zip(*held)])

    def told(*columns):
        for out in made(*columns) if len(columns[0]) else []:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=outs)

    return rows.repartition("token_").sortWithinPartitions(*names[:3]).mapInArrow(run, schema)


def _starts(tokens):
    import numpy as np

    return np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))


def _shared(tokens, sizes, nodes):
    """Rows of groups with several nodes, each node once, under a hash of the group's nodes: equal groups get one name, so they can be made one."""
    import numpy as np
    import xxhash

    fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])))
    tokens, sizes, nodes = tokens[fresh], sizes[fresh], nodes[fresh]
    same = tokens[1:] == tokens[:-1]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    tokens, sizes, nodes = tokens[several], sizes[several], nodes[several]
    if not len(tokens):
        return
    starts = _starts(tokens)
    lengths = np.diff(np.append(starts, len(tokens)))
    names = [xxhash.xxh64_intdigest(nodes[s:s + n].tobytes()) - (1 << 63) for s, n in zip(starts.tolist(), lengths.tolist())]
    yield np.repeat(np.array(names, np.int64), lengths), sizes, nodes


def _stars(tokens, sizes, nodes, weights):
    """Pairs of the shortest node of a group that a node can be linked to by size, and that node, with the group's weight."""
    import numpy as np

    start = np.searchsorted(tokens, tokens)
    rows = np.arange(len(tokens))
    while len(rows):
        near = sizes[start] * OF >= sizes[rows] * SHARE
        a, b, n = nodes[start[near]], nodes[rows[near]], weights[rows[near]]
        yield a[a != b], b[a != b], n[a != b]
        rows = rows[~near]
        start = rows[np.searchsorted(tokens[rows], tokens[rows])]


def _mixed(tokens, sizes, nodes, roots):
    """Rows of groups whose nodes belong to several components."""
    import numpy as np

    starts = _starts(tokens)
    apart = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
    kept = np.repeat(apart, np.diff(np.append(starts, len(tokens))))
    yield tokens[kept], sizes[kept], nodes[kept], roots[kept]


def _possible(tokens, sizes, nodes, roots, sketches):
    """For each node of each group the rows after it, in order of size, that size and bitmap allow and whose component differs: row, rows, bits that differ."""
    import numpy as np

    starts = _starts(tokens)
    for s, e in zip(starts.tolist(), np.append(starts[1:], len(tokens)).tolist()):
        until = s + np.searchsorted(sizes[s:e] * SHARE, sizes[s:e] * OF, side="right")
        bits = np.frombuffer(b"".join(sketches[s:e]), np.uint64).reshape(e - s, -1)
        for i in range(s, e - 1):
            at = np.flatnonzero(roots[i + 1:until[i - s]] != roots[i]) + i + 1
            apart = np.bitwise_count(bits[at - s] ^ bits[i - s]).sum(axis=1, dtype=np.int64)
            fits = apart * (OF + SHARE) <= (sizes[at] + sizes[i]) * (OF - SHARE)
            if fits.any():
                yield i, at[fits], apart[fits]


def _nearest(tokens, sizes, nodes, roots, sketches):
    """Each node that has possible partners in other components of its group with the nearest of them by bitmap, and their distance."""
    import numpy as np

    least, partner = np.full(len(tokens), np.iinfo(np.int64).max), np.full(len(tokens), -1)
    for i, at, apart in _possible(tokens, sizes, nodes, roots, sketches):
        closer = apart < least[at]
        least[at[closer]], partner[at[closer]] = apart[closer], i
        best = int(np.argmin(apart))
        if apart[best] < least[i]:
            least[i], partner[i] = apart[best], at[best]
    met = np.flatnonzero(partner >= 0)
    order = met[np.lexsort((nodes[partner[met]], least[met], nodes[met]))]  # a node once a batch
    order = order[np.concatenate(([True], nodes[order[1:]] != nodes[order[:-1]]))] if len(order) else order
    yield nodes[order], nodes[partner[order]], least[order]


def _crossing(tokens, sizes, nodes, roots, sketches):
    """All pairs of a group that sizes and bitmaps allow and whose components differ, a pair once a batch."""
    import numpy as np

    left, right, held = [], [], 0

    def told():
        pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
        return pairs[0], pairs[1]

    for i, at, _ in _possible(tokens, sizes, nodes, roots, sketches):
        left.append(np.minimum(nodes[at], nodes[i]))
        right.append(np.maximum(nodes[at], nodes[i]))
        held += len(at)
        if held > CHUNK:
            yield told()
            left, right, held = [], [], 0
    if held:
        yield told()


def _with_both(pairs: DataFrame, facts: DataFrame, values: list[str]) -> DataFrame:
    """The pairs a_, b_ with the values of both nodes (`facts` has one row a node), as `<value>a_` and `<value>b_`."""
    total, joined = max(pairs.count(), LEAST_ROWS), pairs
    for side, other in (("a_", "b_"), ("b_", "a_")):
        met = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n_"))
        groups = facts.join(met, F.col("node_") == F.col(side)).select(side, "n_", *[F.col(v).alias(f"{v}{side}") for v in values])
        joined = join_on_group(joined, groups, side, "n_", [f"{v}{side}" for v in values], total, [other])
    return joined


def _used(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_").alias("node_")).union(pairs.select("b_")).distinct()


def _folded(bits: Column, width: Column) -> Column:
    """A bitmap at half its width, where it is wider than `width`. Sizes that can be linked differ by one step at most."""
    half = F.floor(F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > width, F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(bits)


def _near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The staged pairs whose parity bitmaps leave a Jaccard at the bound possible: |A xor B| <= (|A| + |B|) (1 - J) / (1 + J); with that share `apart_`."""
    facts = prints.join(_used(pairs), "node_", "left_semi").groupBy("node_").agg(F.first("size_").alias("size_"), F.first("bits_").alias("bits_"))
    joined = _with_both(pairs, stage_table(facts, "bitmaps"), ["size_", "bits_"])
    sized = joined.filter(F.least("size_a_", "size_b_") * OF >= F.greatest("size_a_", "size_b_") * SHARE)
    a, b = _folded(F.col("bits_a_"), F.size("bits_b_")), _folded(F.col("bits_b_"), F.size("bits_a_"))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    shares = sized.select("a_", "b_", (apart / F.greatest(F.col("size_a_") + F.col("size_b_"), F.lit(1))).alias("apart_"), apart.alias("bits_"), (F.col("size_a_") + F.col("size_b_")).alias("both_"))
    return stage_table(shares.filter(F.col("bits_") * (OF + SHARE) <= F.col("both_") * (OF - SHARE)).select("a_", "b_", "apart_"), "near")


def _checked(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Links that connect the candidates' nodes exactly as all links among the candidates do.

    Each node first meets the nearest of its partners by bitmap; of the other pairs only those between different components are checked then.
    """
    near = _near(pairs, prints)
    nearest = near.groupBy("b_").agg(F.min_by("a_", F.struct("apart_", "a_")).alias("a_")).select("a_", "b_")
    nearest = stage_table(nearest, "nearest")
    links = _linked(nearest, texts, prints)
    roots = stage_table(components(links), "roots").select("node_", "root_")
    rest = near.select("a_", "b_").join(nearest, ["a_", "b_"], "left_anti")
    for side in ("a_", "b_"):
        rest = rest.join(roots.select(F.col("node_").alias(side), F.col("root_").alias(f"root_{side}")), side, "left")
    open_ = stage_table(rest.filter(F.coalesce("root_a_", "a_") != F.coalesce("root_b_", "b_")).select("a_", "b_"), "open")
    return links if open_.isEmpty() else links.unionByName(_linked(open_, texts, prints))


def _linked(pairs: DataFrame, texts: DataFrame, prints: DataFrame) -> DataFrame:
    """The staged pairs a_, b_ whose Jaccard reaches the bound, by the whole sets of both.

    Sets are made again from one text of each node; a Bloom filter of these texts' marks keeps all others where they are.
    """
    import numpy as np

    marks = stage_table(prints.join(_used(pairs), "node_", "left_semi").groupBy("node_").agg(F.min("mark_").alias("hash_")), "marks")
    hashes, rows = marks.select("hash_"), marks.count()
    blocks, size = repeated_filter(hashes.union(hashes), rows)  # every position is set twice, so the filter is one of members
    likely = flag_repeated(texts.select(F.col("mark_").alias("hash_"), "text_"), blocks, size, rows).filter("maybe_").select("hash_", "text_")
    chosen = likely.join(hashes, "hash_", "left_semi").select("text_")
    sets = _hashed(chosen, "node_ long, set_ array<long>", lambda s: (_node(np.unique(s)), _signed(np.unique(s))))
    # Rows repeated in all columns repeat their set and then their pairs, which are made distinct.
    joined = _with_both(pairs, stage_table(sets, "sets"), ["set_"])
    both = F.size(F.array_intersect("set_a_", "set_b_"))
    return stage_table(joined.filter(both * (SHARE + OF) >= (F.size("set_a_") + F.size("set_b_")) * SHARE).select("a_", "b_").distinct(), "links")


def _fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Staged candidates from the forest: each node with the first of its fingerprint, and the first ones of linked fingerprints."""
    nodes = stage_table(prints.select("fp_", "node_").distinct(), "nodes")
    first = stage_table(nodes.groupBy("fp_").agg(F.min("node_").alias("first_"), F.count(F.lit(1)).alias("n_")), "first")
    same = join_on_group(nodes, first.filter("n_ > 1"), "fp_", "n_", ["first_"], max(nodes.count(), LEAST_ROWS), ["node_"]).filter("first_ < node_").select(F.col("first_").alias("a_"), F.col("node_").alias("b_"))
    edges = stage_table(link_edges(first.select("fp_")).distinct(), "forest")
    named = first.select("fp_", "first_")
    left = edges.join(named, F.col("a_") == F.col("fp_")).select(F.col("first_").alias("one_"), "b_")
    across = left.join(named, F.col("b_") == F.col("fp_")).select(F.least("one_", "first_").alias("a_"), F.greatest("one_", "first_").alias("b_"))
    return stage_table(same.unionByName(across).filter("a_ <> b_").distinct(), "candidates")


def _open_groups(shared: DataFrame, roots: DataFrame, prints: DataFrame) -> DataFrame:
    """Staged rows token_, size_, node_, root_, sketch_ of the groups whose nodes belong to several components."""
    rooted = shared.join(roots.select("node_", "root_"), "node_", "left").select("token_", "size_", "node_", F.coalesce("root_", "node_").alias("root_"))
    mixed = stage_table(_by_token(rooted, "token_ long, size_ long, node_ long, root_ long", _mixed), "mixed")
    sketches = prints.select("node_", "sketch_").join(mixed.select("node_").distinct(), "node_", "left_semi").groupBy("node_").agg(F.first("sketch_").alias("sketch_"))
    return stage_table(mixed.join(sketches, "node_").select("token_", "size_", "node_", "root_", "sketch_"), "open_groups")


def _print(shingles, frequent, rank):
    import numpy as np

    distinct = np.unique(shingles)
    return _node(distinct), len(distinct), _fingerprint(shingles), _parity(distinct), _odd(distinct, SKETCH_BITS).tobytes(), _signed(_prefix(distinct, frequent, rank))


def similar_classes(texts: DataFrame) -> DataFrame:
    """Staged rows id_, mark_, root_ of `texts` (id_, mark_, text_): equal roots are connected by links at or above the bound."""
    frequent, rank = _frequent(texts)
    prints = stage_table(_hashed(texts, "node_ long, size_ long, fp_ long, bits_ array<long>, sketch_ binary, prefix_ array<long>", lambda s: _print(s, frequent, rank)), "prints")
    candidates = _fingerprint_pairs(prints)
    tokens = prints.select(F.explode("prefix_").alias("token_"), "size_", "node_")
    named = _by_token(tokens, "token_ long, size_ long, node_ long", _shared)
    shared = stage_table(named.groupBy("token_", "size_", "node_").agg(F.count(F.lit(1)).alias("weight_")), "shared")
    met = _by_token(shared, "a_ long, b_ long, n_ long", _stars).groupBy("b_", "a_").agg(F.sum("n_").alias("n_"))
    most = Window.partitionBy("b_").orderBy(F.desc("n_"), "a_")
    chosen = met.withColumn("at_", F.row_number().over(most)).filter(F.col("at_") <= STARS).select(F.least("a_", "b_").alias("a_"), F.greatest("a_", "b_").alias("b_"))
    tried = stage_table(chosen.unionByName(candidates).distinct(), "stars")
    links = _checked(tried, texts, prints)
    roots = stage_table(components(links), "roots")
    while True:
        open_ = _open_groups(shared, roots, prints)
        near = _by_token(open_, "b_ long, a_ long, apart_ long", _nearest).groupBy("b_").agg(F.min_by("a_", F.struct("apart_", "a_")).alias("a_"))
        pairs = near.select(F.least("a_", "b_").alias("a_"), F.greatest("a_", "b_").alias("b_")).distinct()
        fresh = stage_table(pairs.join(tried, ["a_", "b_"], "left_anti"), "nearest")
        if fresh.isEmpty():
            break
        tried = tried.unionByName(fresh)
        found = _linked(_near(fresh, prints).select("a_", "b_"), texts, prints)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = stage_table(components(links), "roots")
    rest = stage_table(_by_token(open_, "a_ long, b_ long", _crossing).distinct().join(tried, ["a_", "b_"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_checked(rest, texts, prints))
        roots = stage_table(components(links), "roots")
    sized = roots.join(prints.groupBy("node_").agg(F.count(F.lit(1)).alias("n_")), "node_")
    return stage_table(join_on_group(prints.select("id_", "mark_", "node_"), sized, "node_", "n_", ["root_"], prints.count(), ["mark_"]).select("id_", "mark_", F.coalesce("root_", "node_").alias("root_")), "keys")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, but of each group of linked ones only the row with the smallest doc_id."""
    marked = packed(docs).withColumn("mark_", F.xxhash64(F.col(ROW)))
    keys = similar_classes(marked.select(field_of(doc_id).alias("id_"), "mark_", text_of(text).alias("text_")))
    first = keys.groupBy("root_").agg(F.min(F.struct(F.col("id_").isNull().alias("none_"), "id_", "mark_")).alias("first_"))
    keep = stage_table(first.select(F.col("first_.mark_").alias("keep_mark_")), "keep")
    left = marked.join(keep, F.col("mark_") == F.col("keep_mark_"), "left_semi")
    repeated = not keys.groupBy("mark_").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").isEmpty()
    return (left.dropDuplicates(["mark_"]) if repeated else left).select(*unpacked(left, docs))
