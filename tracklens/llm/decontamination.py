"""Benchmark decontamination by winnowing.

Both sides select the smallest K-gram hash of every run of WINDOW - K + 1 K-grams. A span of WINDOW words that both
hold selects the same K-gram in both, so every shared window has an anchor. Anchors are joined, and each
hit is extended: the windows around it are compared exactly, by SHA-256 of their words. An item shorter than a window is a window
itself and its anchor is the hash of all its words.

The benchmark's anchors are broadcast up to `BROADCAST_ANCHORS`; a larger benchmark is joined by shuffle on the
hashes alone, and only documents that were hit are then joined by key.

Nulls: a null text has no words and is never contaminated; null item ids are not listed. Repeated rows give one row each.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import bound, digest, field_of, join_on_group, lowered, packed, scalar, table, text_of, unpacked
from tracklens.session import stage_table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
BROADCAST_ANCHORS = 1_000_000
STRETCH = 64
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1
SHARE = 20


def words_of(text: Column) -> Column:
    """The words of a text: what lies between runs of other characters. Splitting is several times cheaper than extracting."""
    return F.array_remove(F.split(lowered(text), NOT_WORD, -1), "")


def _placed(hash_: Column, place: Column) -> Column:
    """Hash in the upper bits, place in the text in the lower ones; the smallest is the leftmost of the smallest."""
    return hash_.bitwiseAND(F.lit(((1 << 63) - 1) & ~PLACES)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(PLACES)))


def _minima(values: Column, span: int) -> Column:
    """The smallest of every `span` neighbours, by doubling; the last span - 1 places see fewer and come out too."""
    def doubled(v: Column, width: int) -> Column:
        if width == span:
            return v
        step = min(width, span - width)
        return bound(F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda x, y: F.least(x, y)), lambda w: doubled(w, width + step))

    return bound(values, lambda v: doubled(v, 1))


def winnowed(words: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Selected K-grams of a word array, each once; empty below a window's length. A word is hashed once, its K-grams from the hashes."""
    span = window - gram + 1

    def grams(h: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(h) - gram), lambda i: _placed(F.xxhash64(F.lit(window), *[F.get(h, i + k) for k in range(gram)]), i))
        return F.array_distinct(bound(_minima(hashed, span), lambda m: F.slice(m, 1, F.size(m) - span + 1)))

    return F.when(F.size(words) >= window, bound(F.transform(words, lambda w: F.xxhash64(w)), grams)).otherwise(F.array().cast("array<long>"))


def whole_grams(words: Column, length: int) -> Column:
    """Hash of every run of `length` words; the anchors of items that are shorter than a window."""
    runs = bound(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - length), lambda i: _placed(F.xxhash64(F.lit(length), F.array_join(F.slice(w, i + 1, length), " ")), i)))
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast("array<long>"))


def _run_digest(words: Column, start: Column, length: Column) -> Column:
    """SHA-256 of `length` words from the 0-based `start`. Words hold no space, so the joined text is unique."""
    return digest(F.array_join(F.slice(words, start + 1, length), " "))


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every distinct pair of a window of the benchmark, by its digest, and an item that holds it."""
    rows = packed(items).select(field_of(item_id).cast("string").alias("item_"), words_of(text_of(text)).alias("words_")).filter(F.size("words_") > 0)
    sized = rows.withColumn("length_", F.least(F.size("words_"), F.lit(window)))
    starts = sized.withColumn("start_", F.explode(F.sequence(F.lit(0), F.size("words_") - F.col("length_"))))
    return starts.select(_run_digest(F.col("words_"), F.col("start_"), F.col("length_")).alias("window_"), "item_").distinct()


def benchmark_anchors(items: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Distinct anchor hashes of the benchmark with the length of the window they stand for."""
    rows = packed(items).select(words_of(text_of(text)).alias("words_")).filter(F.size("words_") > 0)
    long = rows.filter(F.size("words_") >= window).select(F.lit(window).alias("length_"), F.explode(winnowed(F.col("words_"), window, gram)).alias("placed_"))
    whole = _placed(F.xxhash64(F.size("words_"), F.array_join("words_", " ")), F.lit(0))
    short = rows.filter(F.size("words_") < window).select(F.size("words_").alias("length_"), whole.alias("placed_"))
    return long.unionByName(short).select("length_", F.shiftright("placed_", PLACE_BITS).alias("anchor_")).distinct()


def _window_starts(n_words: Column, length: Column, place: Column, window: int, gram: int) -> Column:
    """Starts of all windows that can hold an anchor at `place`."""
    back = F.when(length == window, F.lit(window - gram)).otherwise(F.lit(0))
    return F.filter(F.sequence(place - back, place), lambda s: (s >= 0) & (s <= n_words - length))


def _stretches(worded: DataFrame, window: int) -> DataFrame:
    """Texts as stretches of STRETCH words and the window - 1 words after them, with the place `offset_` of the first: every window lies in one.

    What follows copies a stretch for each of its marks, so the work grows with a text's length and not with its square.
    """
    cut = F.transform(F.sequence(F.lit(0), F.size("words_") - 1, F.lit(STRETCH)), lambda i: F.struct(i.alias("offset_"), F.slice("words_", i + 1, STRETCH + window - 1).alias("words_")))
    return worded.filter(F.size("words_") > 0).select("id_", "sha_", F.explode(cut).alias("s_")).select("id_", "sha_", "s_.*")


def _hit_windows(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_text: str, window: int, gram: int) -> DataFrame:
    """Digest of each document window next to an anchor: id_, sha_, length_, start_, window_."""
    anchors = stage_table(benchmark_anchors(items, item_text, window, gram), "anchors")
    shorter = [r.length_ for r in anchors.select("length_").distinct().filter(F.col("length_") < window).collect()]
    base = packed(docs).select(field_of(doc_id).alias("id_"), text_of(text).alias("text_"))
    worded = _stretches(base.select("id_", digest(F.col("text_")).alias("sha_"), words_of(F.col("text_")).alias("words_")), window)
    marks = F.concat(winnowed(F.col("words_"), window, gram), *[whole_grams(F.col("words_"), n) for n in sorted(shorter)])
    marked = worded.select("id_", "sha_", "offset_", "words_", marks.alias("marks_"))
    key = F.shiftright("placed_", PLACE_BITS) == F.col("anchor_")
    place = F.col("placed_").bitwiseAND(F.lit(PLACES)).cast("int")
    if anchors.count() <= BROADCAST_ANCHORS:
        hits = marked.select("id_", "sha_", "offset_", "words_", F.explode("marks_").alias("placed_")).join(F.broadcast(anchors), key)
    else:
        found = marked.select("id_", "sha_", "offset_", F.explode("marks_").alias("placed_")).join(anchors, key).select("id_", "sha_", "offset_", "length_", "placed_").distinct()
        places = found.groupBy("id_", "sha_", "offset_").agg(F.collect_list(F.struct("length_", "placed_")).alias("found_"))
        once = worded.dropDuplicates(["id_", "sha_", "offset_"])
        same = F.expr("d.id_ <=> p.id_ AND d.sha_ = p.sha_ AND d.offset_ = p.offset_")
        hits = once.alias("d").join(places.alias("p"), same).select("d.id_", "d.sha_", "d.offset_", "words_", F.explode("found_").alias("f_")).select("id_", "sha_", "offset_", "words_", "f_.*")
    starts = hits.withColumn("from_", F.explode(_window_starts(F.size("words_"), F.col("length_"), place, window, gram)))
    return starts.select("id_", "sha_", "length_", (F.col("offset_") + F.col("from_")).alias("start_"), _run_digest(F.col("words_"), F.col("from_"), F.col("length_")).alias("window_"))


def hits_per_document(docs: DataFrame, pairs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents that hold a benchmark window, by id_ and sha_ of the text: spans_ (sorted start and length), n_hit_, windows_ (sorted digests).

    `pairs` are the staged windows and items of the benchmark.
    """
    windows = pairs.select("window_").distinct()
    side = F.broadcast(windows) if pairs.count() <= BROADCAST_ANCHORS else windows
    found = _hit_windows(docs, items, doc_id, text, item_text, window, gram).join(side, "window_", "left_semi")
    per_doc = found.groupBy("id_", "sha_").agg(
        F.array_sort(F.collect_set(F.struct("start_", "length_"))).alias("spans_"), F.array_sort(F.collect_set("window_")).alias("windows_")
    )
    covered = F.aggregate(
        "spans_", F.struct(F.lit(0).alias("end_"), F.lit(0).cast("long").alias("n_")),
        lambda acc, s: F.struct(
            F.greatest(acc["end_"], s["start_"] + s["length_"]).alias("end_"),
            (acc["n_"] + F.greatest(F.lit(0), s["start_"] + s["length_"] - F.greatest(acc["end_"], s["start_"]))).cast("long").alias("n_"),
        ),
    )
    return per_doc.select("id_", "sha_", "spans_", covered["n_"].alias("n_hit_"), "windows_")


def hit_items(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Staged hits with n_items_ and items_sha_, the SHA-256 of the sorted items, comma-joined.

    Documents with the same windows have the same items, so items are looked up once for each distinct set of windows, as (set, item) pairs.
    """
    keyed = hits.withColumn("set_", F.unhex(F.sha2(F.array_join(F.transform("windows_", lambda w: F.hex(w)), ""), 256)))
    sets = stage_table(keyed.groupBy("set_").agg(F.first("windows_").alias("windows_"), F.count(F.lit(1)).alias("docs_")), "sets")
    members = sets.select("set_", F.explode("windows_").alias("window_")).join(pairs, "window_").select("set_", "item_").filter("item_ IS NOT NULL").distinct()
    listed = members.groupBy("set_").agg(F.array_sort(F.collect_list("item_")).alias("items_"))
    named = listed.select("set_", F.size("items_").cast("long").alias("n_items_"), F.sha2(F.array_join("items_", ","), 256).alias("items_sha_"))
    facts = stage_table(sets.select("set_", "docs_").join(named, "set_"), "items")
    total = scalar(facts.agg(F.sum("docs_")))[0] or 0
    return stage_table(join_on_group(keyed.drop("windows_", "spans_"), facts, "set_", "docs_", ["n_items_", "items_sha_"], total, ["id_", "sha_"]).drop("set_"), "named")


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    pairs = stage_table(benchmark_windows(items, item_id, item_text), "windows")
    hits = hit_items(stage_table(hits_per_document(docs, pairs, items, doc_id, text, item_text), "hits"), pairs)
    rows = packed(docs).select(
        field_of(doc_id).alias("doc_id"), digest(text_of(text)).alias("text_sha_"), F.size(words_of(text_of(text))).cast("long").alias("n_words")
    )
    joined = rows.join(hits, F.expr("doc_id <=> id_ AND text_sha_ = sha_"), "left")
    n_hit = F.coalesce("n_hit_", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items_", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha_", F.sha2(F.lit(""), 256)).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    pairs = stage_table(benchmark_windows(items), "windows")
    hits = stage_table(hits_per_document(docs, pairs, items, doc_id, text).select("id_", "sha_", "n_hit_"), "hits")
    base = packed(docs)
    joined = base.join(hits, field_of(doc_id).eqNullSafe(F.col("id_")) & (digest(text_of(text)) == F.col("sha_")), "left")
    n_words = F.size(words_of(text_of(text)))
    return joined.filter(F.col("n_hit_").isNull() | ~_contaminated(F.col("n_hit_"), n_words)).select(*unpacked(joined, docs))


def op9_decontamination(spark, sf_dir) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, l, array_to_string(w[i + 1:i + l], ' ') AS g FROM (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM s)),
k AS (SELECT DISTINCT l FROM v),
p AS (SELECT doc_id, l, i, array_to_string(w[i + 1:i + l], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM d, k WHERE len(w) >= l)),
h AS (SELECT doc_id, i, p.l, item_id FROM p JOIN v ON p.g = v.g AND p.l = v.l),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(j, ',' ORDER BY j) AS js FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS j FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(js, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
