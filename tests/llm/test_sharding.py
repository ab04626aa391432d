import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tracklens.llm import sharding as S


def by_hand(rows, shards):
    """Shard and slot of each row (id, text): the definition, row by row."""
    key = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)
    order = sorted(((key(t or ""), (i is not None, i or 0), i, len((t or "").encode()) + 8) for i, t in rows), key=lambda r: r[:2])
    total, groups, before = sum(r[3] for r in order), defaultdict(list), 0
    for k, _, i, size in order:
        groups[k].append((i, size, before))
        before += size
    out, slots = [], defaultdict(int)
    for k, members in groups.items():
        bytes_, start = sum(m[1] for m in members), members[0][2]
        for i, size, at in members:
            middle = 2 * start + bytes_ if bytes_ * S.TOGETHER * shards <= total else 2 * at + size
            shard = min(shards - 1, middle * shards // (2 * total))
            out.append((i, size, shard, slots[shard]))
            slots[shard] += 1
    return sorted(out, key=str)


def placed(df):
    return sorted([(r.doc_id, r.size, r.shard, r.slot) for r in df.collect()], key=str)


def shards_of(docs, shards, rows_per_range):
    made = S._sharded(docs, "doc_id", "text", shards, rows_per_range, F.lit(0))
    return made.select(F.col("id_").alias("doc_id"), F.col("size_").alias("size"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"))


def test_equals_the_definition_whatever_the_ranges(spark, documents):
    want = by_hand([(r.doc_id, r.text) for r in documents.collect()], 24)
    assert placed(shards_of(documents, 24, 500_000)) == want
    assert placed(shards_of(documents.repartition(3), 24, 7)) == want


def test_a_crowd_of_copies_is_subdivided(spark):
    rows = [(i, "same") for i in range(4000)] + [(i, f"text {i} " * (i % 40)) for i in range(4000, 12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert placed(shards_of(docs, 5, 300)) == by_hand(rows, 5)
    keyed = docs.select(F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long").alias("key_"), F.col("doc_id").alias("id_"),
                        (F.octet_length("text") + 8).cast("long").alias("size_"), F.monotonically_increasing_id().alias("line_"))
    _, stats = S.into_ranges(keyed, 5, 300)
    sizes = stats.collect()
    mean_rows, mean_bytes = 12000 / 160, sum(r.bytes_ for r in sizes) / 160
    assert max(r.rows_ for r in sizes) <= 2 * mean_rows and max(r.bytes_ for r in sizes) <= 2 * mean_bytes
    made = shards_of(docs, 5, 300).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    whole = sum(r.bytes for r in made)
    assert all(abs(r.bytes - whole / 5) <= whole / 5 / S.TOGETHER + 1000 and r.last == r.n - 1 for r in made)


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text {i % 3000} of some length") for i in range(9000)]
    made = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1")
    assert made.isEmpty()


def test_odd_rows_and_empty_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert placed(shards_of(odd, 3, 2)) == by_hand(rows, 3)
    clash = odd.withColumn("shard", F.lit("x")).withColumn("key_", F.lit(1)).withColumn("size_", F.lit(None).cast("string")).withColumn("range_", F.lit(1))
    made = S.shard(clash, shards=3)
    assert made.columns == [*[c for c in clash.columns if c != "shard"], "shard", "slot"] and made.count() == len(rows)
    assert S.shard(odd.limit(0)).count() == 0
    one = S.shard(odd.filter("doc_id = 8")).collect()
    assert [(r.shard, r.slot) for r in one] == [(12, 0)]


def test_written_shards_hold_every_row_in_slot_order(spark, documents, tmp_path):
    S.write_shards(documents, str(tmp_path / "out"), shards=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in documents.collect())
    for shard in range(6):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == list(range(len(slots)))


def test_query_gives_sizes_and_checksums(spark, small, documents):
    from tracklens.llm.queries import QUERIES

    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for r in QUERIES["op11_sharding"](spark, small).collect():
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "bytes", None)


def test_stays_native(spark, documents):
    made = S._sharded(documents, "doc_id", "text", 24, 500_000, F.lit(0))
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
