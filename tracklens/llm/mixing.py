"""Mixing sources to target weights by weighted fair queueing.

Every document copy gets a virtual finish time: its source's words served up to and including it, in a hashed
order, divided by the source's target. Copies are range-sorted by finish time over the whole corpus and the
sequence is cut at the total budget. A source whose target exceeds its size is served again from the start, `REPEATS`
times at most.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is ordered first. Rows
equal in all of source, doc_id and text are interchangeable. Sources without words have target 0 and give nothing.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tracklens.llm.common import ROW, field_of, join_on_group, packed, ranged_running_sum, scalar, table, text_of, unpacked
from tracklens.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 20240611
BROADCAST_SOURCES = 100_000
ORDER = ["no_source_", "source_", "draw_", "id_", "tie_"]


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Add `target_` to staged sources (`words_`, `rank_`): weighted shares of the budget, capped at `repeats` times the size.

    The excess of capped sources is shared again by weight until no source is above its cap. Only three sums reach the driver.
    """
    weighted = sources.withColumn("weight_", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank_") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("words_") * F.lit(float(repeats))
    budget = float(scalar(sources.agg(F.sum("words_")))[0] or 0) * share
    level, full = 0.0, F.lit(False)
    while True:
        sums = scalar(weighted.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight_")))))
        if not sums[1]:
            break
        higher = (budget - (sums[0] or 0.0)) / sums[1]
        if higher <= level:
            break
        level = higher
        full = cap <= F.col("weight_") * F.lit(level)
    return weighted.withColumn("target_", F.when(full, cap).otherwise(F.col("weight_") * F.lit(level)))


def _finish(repeat: Column) -> Column:
    """Virtual finish time of a copy; null where the source has no target."""
    return F.when(F.col("target_") > 0, (repeat * F.col("words_") + F.col("served_")).cast("double") / F.col("target_"))


def _copy(repeat: Column) -> Column:
    return F.struct(_finish(repeat).alias("finish_"), F.col("rank_"), F.col("draw_"), F.col("id_"), F.col("tie_"), repeat.cast("int").alias("repeat_"))


def _queued(docs: DataFrame, doc_id: str, text: str, source: str, payload: Column, weights, share, repeats):
    """Documents with their source's words and target, their words served so far, and the last copy within the budget."""
    rows = packed(docs).select(
        payload.alias(ROW), field_of(doc_id).alias("id_"), field_of(source).alias("source_"), field_of(source).isNull().alias("no_source_"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size_"),
        F.xxhash64(F.lit(SEED), field_of(doc_id)).alias("draw_"), F.xxhash64(text_of(text)).alias("tie_"),
    )
    running = ranged_running_sum(rows, ORDER, ["size_"], "served")
    totals = running.groupBy("no_source_", "source_").agg(F.sum("size_").alias("words_"), F.count(F.lit(1)).alias("docs_"), F.lit(1).cast("long").alias("one_"))
    ranked = ranged_running_sum(totals, ["no_source_", "source_"], ["words_", "one_"], "sources").withColumnRenamed("run_one_", "rank_")
    sources = stage_table(source_targets(ranked, weights, share, repeats).select(
        F.when(F.col("no_source_"), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source_").cast("string"))).alias("key_"),
        "words_", "docs_", "rank_", "target_", (F.col("run_words_") - F.col("words_")).alias("start_")), "targets")
    keyed = running.withColumn("key_", F.when(F.col("no_source_"), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source_").cast("string"))))
    values = ["words_", "rank_", "target_", "start_"]
    if sources.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(sources.select("key_", *values)), "key_")
    else:
        joined = join_on_group(keyed, sources, "key_", "docs_", values, running.count(), ["draw_", "id_"])
    queued = joined.withColumn("served_", F.col("run_size_") - F.col("start_"))
    budget = scalar(sources.agg(F.floor(F.sum("target_") + F.lit(1e-6)).cast("long")))[0] or 0
    copies = queued.select("size_", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: _copy(r))).alias("copy_")).filter("copy_.finish_ IS NOT NULL")
    line = ranged_running_sum(copies, ["copy_"], ["size_"], "line")
    last = scalar(line.filter(F.col("run_size_") <= F.lit(budget)).agg(F.max("copy_")))[0]
    return queued, last


def _taken(queued: DataFrame, repeats: int, last) -> Column:
    """The repeats of a document that come no later than the last copy within the budget."""
    if last is None:
        return F.array().cast("array<int>")
    end = F.lit(last.finish_)
    tail = F.struct(F.lit(last.rank_).alias("rank_"), F.lit(last.draw_).alias("draw_"), F.lit(last.id_).cast(queued.schema["id_"].dataType).alias("id_"), F.lit(last.tie_).alias("tie_"), F.lit(last.repeat_).alias("repeat_"))
    mine = lambda r: F.struct(F.col("rank_"), F.col("draw_"), F.col("id_"), F.col("tie_"), r.cast("int").alias("repeat_"))
    return F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: (_finish(r) < end) | ((_finish(r) == end) & (mine(r) <= tail)))


def mix_amounts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words that the mix takes)."""
    queued, last = _queued(docs, doc_id, text, source, F.lit(0), weights, share, repeats)
    return queued.select(
        F.col("id_").alias("doc_id"), F.col("size_").alias("size"), F.col("words_").alias("source_size"), F.col("target_").alias("target"),
        (F.col("size_") * F.size(_taken(queued, repeats, last))).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """The mixed sequence: a row for each copy taken with all columns, `mix_repeat` and `mix_finish`, range-sorted by finish time."""
    queued, last = _queued(docs, doc_id, text, source, F.col(ROW), weights, share, repeats)
    copies = queued.withColumn("repeat_", F.explode(_taken(queued, repeats, last))).withColumn("finish_", _finish(F.col("repeat_")))
    line = copies.repartitionByRange("finish_", "rank_", "draw_", "repeat_").sortWithinPartitions("finish_", "rank_", "draw_", "id_", "tie_", "repeat_")
    own = [(F.col("repeat_"), "mix_repeat"), (F.col("finish_"), "mix_finish")]
    return line.select(*unpacked(line, docs), *[c.alias(name) for c, name in own if name not in docs.columns])


def op6_source_mixing(spark, sf_dir) -> DataFrame:
    return mix_amounts(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
