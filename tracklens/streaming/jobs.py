"""Structured Streaming forms of the event-time operators."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracklens.config import SceneConfig
from tracklens.operators.ordered import blocked_lag, blocked_running_sum
from tracklens.operators.ticks import DAY, STATE
from tracklens.session import prepare, shared_folder

END_US = 9_000_000_000_000_000  # year 2255, after all reports: the end of a bounded input


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int = 1_000) -> DataFrame:
    """A table of the folder as a stream of files; the file limit bounds each micro-batch.

    The path is a glob of exactly one name, which the stream source reads alike as one file and as a folder of files.
    """
    schema = prepare(spark).read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/{name}.parque[t]")


def use_durable_state(spark: SparkSession) -> None:
    """Custom stateful processors keep their state in RocksDB, checkpointed with the query."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _run(stream: DataFrame, base: str) -> DataFrame:
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, append to a table in the shared folder, and read it back."""
    return _run(stream, f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}")


@contextmanager
def _partition_per_core(spark: SparkSession) -> Iterator[None]:
    """Each state partition costs a store and a worker in every batch, whatever it holds."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def run_to_end(reports: DataFrame, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run `job` over a bounded stream of reports and release what is still open at its end.

    The same query, with the same checkpoint, runs once over the reports and once more over one marker row at `END_US`. The
    marker moves the watermark past every window and timer; nothing of its own is released, as its time never passes.
    State has one partition per core of the cluster.
    """
    spark = reports.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    marker = spark.range(1).select(*[
        {"timestamp_us": F.lit(END_US), "event_time": F.timestamp_micros(F.lit(END_US))}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in reports.schema.fields
    ])
    marker.limit(0).write.parquet(f"{base}/end")
    whole = job(reports.unionByName(spark.readStream.schema(marker.schema).parquet(f"{base}/end")))
    with _partition_per_core(spark):
        _run(whole, base)
        marker.write.mode("append").parquet(f"{base}/end")
        return _run(whole, base)


def replay_in_order(
    inputs: dict[str, DataFrame], job: Callable[[dict[str, DataFrame]], DataFrame], name: str, slices: int = 3, finish: bool = True
) -> DataFrame:
    """Run `job` over tables that arrive in time order: one slice of time after another, each a run of the same query.

    Every input has `timestamp_us`; the streams also carry `event_time`. As arrival follows time, a watermark delay of minutes
    loses nothing, and between slices state holds live rows only. Slices hold about equal numbers of rows, equal times stay together.
    `finish` brings the marker row at `END_US` last, which releases what is still open. State has one partition per core of the cluster.
    """
    spark = next(iter(inputs.values())).sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    timed = {n: df.withColumn("event_time", F.timestamp_micros("timestamp_us")) for n, df in inputs.items()}
    streams = {}
    for n, df in timed.items():
        df.limit(0).write.parquet(f"{base}/in-{n}")
        streams[n] = spark.readStream.schema(df.schema).parquet(f"{base}/in-{n}")
    times = None
    for df in inputs.values():
        times = df.select("timestamp_us") if times is None else times.union(df.select("timestamp_us"))
    cuts = times.agg(F.percentile_approx("timestamp_us", [(i + 1) / slices for i in range(slices - 1)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    whole = job(streams)
    with _partition_per_core(spark):
        for low, high in zip(edges, edges[1:]):
            for n, df in timed.items():
                after = F.lit(True) if low is None else F.col("timestamp_us") > low
                until = F.lit(True) if high is None else F.col("timestamp_us") <= high
                df.filter(after & until).write.mode("append").parquet(f"{base}/in-{n}")
            out = _run(whole, base)
        if finish:
            for n, df in timed.items():
                # Filters that the optimiser infers from joins move below the watermark, so the marker has values that pass them.
                marker = {"timestamp_us": F.lit(END_US), "event_time": F.timestamp_micros(F.lit(END_US))}
                blank = lambda f: F.lit("" if f.dataType.simpleString() == "string" else 0)
                row = spark.range(1).select(*[marker.get(f.name, blank(f)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
                row.write.mode("append").parquet(f"{base}/in-{n}")
            out = _run(whole, base)
    return out


def replay_delay(reports: DataFrame) -> str:
    """A watermark delay under which files of a bounded input may arrive in any order: the span of its times (batch rows)."""
    low, high = reports.agg(F.min("timestamp_us"), F.max("timestamp_us")).first()
    return "0 seconds" if low is None else _seconds(high - low + 1_000_000)


def _seconds(us: int) -> str:
    return f"{us // 1_000_000} seconds"


def carry_forward(reports: DataFrame, cfg: SceneConfig, delay: str) -> DataFrame:
    """Latest report per aircraft at each tick of an epoch-anchored grid.

    A report can only serve ticks from its own time to its expiry, so it is copied to those ticks and the
    latest copy wins. State lives until the watermark passes the tick; nothing later than a tick enters it.
    """
    step, stale = cfg.step_us, cfg.stale_us
    first = F.expr(f"(timestamp_us + {step - 1}) div {step}")
    last = F.when(F.col("timestamp_us") < END_US, F.expr(f"(timestamp_us + {stale}) div {step}")).otherwise(first)
    placed = reports.withColumn("k", F.explode(F.sequence(first, last))).withColumn("tick_time", F.timestamp_micros(F.col("k") * step))
    latest = F.max(F.struct("timestamp_us", "source_file_id", *STATE))
    return (
        placed.withWatermark("tick_time", delay).groupBy("airport_id", "aircraft_id", "k", F.window("tick_time", _seconds(step)))
        .agg(latest.alias("r")).select("airport_id", "aircraft_id", "k", "r.*")
    )


def last_per_window(reports: DataFrame, width_us: int, delay: str) -> DataFrame:
    """Last report per aircraft, source and tumbling window."""
    payload = F.struct("timestamp_us", "event_id", "altitude_m")
    return (
        reports.withWatermark("event_time", delay).groupBy("airport_id", "source_file_id", "aircraft_id", F.window("event_time", _seconds(width_us)).alias("w"))
        .agg(F.max(payload).alias("r")).select("airport_id", "source_file_id", "aircraft_id", F.unix_micros("w.start").alias("window_us"), "r.*")
    )


def activity(reports: DataFrame, width_us: int, delay: str, slide_us: int | None = None) -> DataFrame:
    """Distinct aircraft and rows per window: one count per aircraft first, so no distinct set is held."""
    window = F.window("event_time", _seconds(width_us), _seconds(slide_us)) if slide_us else F.window("event_time", _seconds(width_us))
    per = reports.withWatermark("event_time", delay).groupBy("airport_id", "aircraft_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # A window's own time is just before its end, so the second, tumbling window ends with the first one.
    ended = per.groupBy("airport_id", F.window(F.window_time("w"), _seconds(slide_us or width_us)).alias("v"))
    return ended.agg(F.count(F.lit(1)).alias("aircraft"), F.sum("n").alias("n_rows")).select(
        "airport_id", (F.unix_micros("v.end") - width_us).alias("window_us"), "aircraft", "n_rows"
    )


def resolve_keys(reports: DataFrame, delay: str) -> DataFrame:
    """Winner per natural key: least age class, least age, first event. Keys close with their window."""
    age = F.col("age_s")
    rank = F.struct(F.when(age.isNull(), 2).when(age >= 0, 0).otherwise(1).alias("c"), F.abs(age).alias("a"), "event_id")
    return (
        reports.withWatermark("event_time", delay).groupBy("airport_id", "aircraft_id", "timestamp_us", F.window("event_time", "1 second"))
        .agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("group_size"))
        .select("airport_id", "aircraft_id", "timestamp_us", "group_size", F.col("r.event_id").alias("event_id"))
    )


def matured_days(reports: DataFrame, delay: str) -> DataFrame:
    """Daily totals, released only once the delay (the longest horizon or more) after the day has passed."""
    return (
        reports.withWatermark("event_time", delay).groupBy("airport_id", F.window("event_time", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("timestamp_us").alias("last_us")).select("airport_id", F.unix_micros("w.start").alias("day_us"), "n_rows", "last_us")
    )


class OrderCheck(StatefulProcessor):
    """Per source and block: flags rows whose time is below that of the row before them in ordinal order.

    State holds the rows that still miss a neighbour, so batches may bring the ordinals in any sequence; a block that is
    complete keeps nothing.
    """

    def __init__(self, block_rows: int):
        self.block_rows = block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edge = handle.getListState("edge", "ordinal long, timestamp_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["ordinal", "timestamp_us"]].assign(new=True)
        old = pd.DataFrame(list(self.edge.get()), columns=["ordinal", "timestamp_us"]).assign(new=False)
        frame = pd.concat([old, new], ignore_index=True) if len(old) else new
        frame = frame.astype({"ordinal": "int64", "timestamp_us": "int64", "new": "bool"}).sort_values("ordinal", kind="stable")
        before, after = frame.shift(1), frame.shift(-1)
        follows, followed = before["ordinal"] == frame["ordinal"] - 1, after["ordinal"] == frame["ordinal"] + 1
        unseen = frame["new"] | before["new"].eq(True)
        late = frame[follows & unseen & (frame["timestamp_us"] < before["timestamp_us"])]
        first, last = int(key[1]) * self.block_rows - 1, (int(key[1]) + 1) * self.block_rows - 1
        open_ = frame[~((follows | (frame["ordinal"] == max(first, 0))) & (followed | (frame["ordinal"] == last)))]
        if len(open_):
            self.edge.put([(int(o), int(t)) for o, t in zip(open_["ordinal"], open_["timestamp_us"])])
        else:
            self.edge.clear()  # an empty list is no legal state
        yield pd.DataFrame({"source_file_id": key[0], "ordinal": late["ordinal"], "timestamp_us": late["timestamp_us"]})

    def close(self) -> None:
        pass


def order_violations(rows: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """Rows whose time is below that of the preceding row of their source.

    `ordinal` numbers the accepted rows of a source without gaps. State is kept per block of ordinals, and a
    block's last row is also sent to the next block, so a large source is spread over many keys and every
    key sees a bounded number of rows.
    """
    block, last = F.floor(F.col("ordinal") / block_rows), F.pmod(F.col("ordinal"), F.lit(block_rows)) == block_rows - 1
    blocks = F.when(last, F.array(block, block + 1)).otherwise(F.array(block))
    keyed = rows.select("source_file_id", "ordinal", "timestamp_us", F.explode(blocks).alias("block"))
    return keyed.groupBy("source_file_id", "block").transformWithStateInPandas(
        OrderCheck(block_rows), "source_file_id string, ordinal long, timestamp_us long", "append", "none"
    )


def _lane(lanes: int):
    """The lane of an aircraft: one state key serves all aircraft of a lane, so calls grow with lanes and not with aircraft."""
    return F.pmod(F.xxhash64("aircraft_id"), F.lit(lanes)).cast("long").alias("lane")


class RunTracker(StatefulProcessor):
    """Per lane of aircraft and time block: runs of an unchanged value, released when the watermark passes the block."""

    columns = ["aircraft_id", "timestamp_us", "event_id", "value"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "aircraft_id string, timestamp_us long, event_id long, value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            self.handle.registerTimer(int(key[2]) // 1_000)
        for frame in rows:
            self.rows.appendList(list(zip(frame["aircraft_id"], *(frame[c].astype("int64").tolist() for c in self.columns[1:]))))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(list(self.rows.get()), columns=self.columns).sort_values(self.columns[:3], kind="stable")
        self.rows.clear()
        number = ((frame["aircraft_id"] != frame["aircraft_id"].shift(1)) | (frame["value"] != frame["value"].shift(1))).cumsum()
        runs = frame.groupby(number).agg(
            aircraft_id=("aircraft_id", "first"), value=("value", "first"), first_us=("timestamp_us", "min"), last_us=("timestamp_us", "max"), n=("value", "size"))
        yield runs.assign(block=int(key[1]), piece=runs.groupby("aircraft_id").cumcount()).reset_index(drop=True)

    def close(self) -> None:
        pass


def run_pieces(reports: DataFrame, delay: str, block_us: int = 3_600_000_000, lanes: int = 32) -> DataFrame:
    """Value runs per aircraft, cut at time blocks: block and piece give their order.

    A block of a lane is one key, so a busy aircraft is spread over its blocks, and state ends with the block whatever the order of batches.
    """
    block = F.floor(F.col("timestamp_us") / block_us)
    # The end marker moves the watermark only; a filter on the event time stays above the watermark.
    real = reports.withWatermark("event_time", delay).filter(F.col("event_time") < F.timestamp_micros(F.lit(END_US)))
    keyed = real.select(
        _lane(lanes), "aircraft_id", "event_id", "timestamp_us", "value", "event_time", block.alias("block"), ((block + 1) * block_us).alias("end_us")
    )
    return keyed.groupBy("lane", "block", "end_us").transformWithStateInPandas(
        RunTracker(), "aircraft_id string, block long, piece long, value long, first_us long, last_us long, n long", "append", "eventTime"
    )


def joined_runs(pieces: DataFrame) -> DataFrame:
    """Maximal runs from released pieces, in batch: pieces of one value that follow each other are one run."""
    order, month = ["block", "piece"], F.floor(F.col("block") / 720)
    lagged = blocked_lag(pieces, ["aircraft_id"], month, order, ["value"])
    starts = lagged.withColumn("starts", (F.col("prev").isNull() | (F.col("prev.value") != F.col("value"))).cast("long")).drop("prev")
    numbered = blocked_running_sum(starts, ["aircraft_id"], month, order, "starts", "run")
    return numbered.groupBy("aircraft_id", "run").agg(
        F.first("value").alias("value"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")
    ).drop("run")


class TickKeeper(StatefulProcessor):
    """Per day and lane of aircraft: the reports that can still serve a tick. A timer at the next tick that a live report
    serves releases every tick the watermark has passed and sets the next timer; reports past their bound leave the state.

    Held are, for each aircraft, at most one report for each tick between the watermark and the newest report, and the one in force.
    """

    def __init__(self, step_us: int, stale_us: int):
        self.step_us, self.stale_us = step_us, stale_us
        self.columns = ["aircraft_id", "k", "timestamp_us", "source_file_id", *STATE]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "aircraft_id string, k long, timestamp_us long, source_file_id string, "
        self.live = handle.getListState("live", fields + ", ".join(f"{c} double" for c in STATE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new["k"] = -((int(key[3]) - new["timestamp_us"]) // self.step_us)  # first tick at or after the report
        self._hold(key, pd.concat([self._held(), new[self.columns]], ignore_index=True))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, t0 = self._held(), int(key[3])
        if not len(held):
            yield pd.DataFrame()
            return
        passed = (timerValues.getCurrentWatermarkInMs() * 1_000 - t0) // self.step_us
        first, bound = held["k"].to_numpy(), (held["timestamp_us"].to_numpy() + self.stale_us - t0) // self.step_us
        # Reports are held by aircraft and tick, so the next row is the successor unless it is another aircraft's.
        successor = held["k"].shift(-1).where(held["aircraft_id"] == held["aircraft_id"].shift(-1))
        last = np.minimum(bound, successor.fillna(np.iinfo(np.int32).max).to_numpy().astype("int64") - 1)
        n = np.maximum(np.minimum(last, passed) - first + 1, 0)
        out = held.loc[np.repeat(held.index, n)].reset_index(drop=True)
        out["k"] = out["k"] + (np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n))
        self._hold(key, held.assign(k=np.maximum(first, passed + 1))[last > passed])
        yield out.assign(airport_id=key[0], source_day=key[1], t0_us=t0)

    def _held(self) -> pd.DataFrame:
        frame = pd.DataFrame(list(self.live.get()), columns=self.columns)
        text = {"aircraft_id": "object", "source_file_id": "object"}
        return frame.astype({"k": "int64", "timestamp_us": "int64", **text, **{c: "float64" for c in STATE}})

    def _hold(self, key, frame: pd.DataFrame) -> None:
        latest = frame.sort_values(["aircraft_id", "k", "timestamp_us", "source_file_id"], kind="stable").drop_duplicates(["aircraft_id", "k"], keep="last")
        if not len(latest):
            self.live.clear()
            return
        self.live.put(list(zip(*(latest[c].tolist() for c in self.columns))))
        self.handle.registerTimer(-((-int(key[3]) - int(latest["k"].min()) * self.step_us) // 1_000))

    def close(self) -> None:
        pass


def keyed_ticks(reports: DataFrame, cfg: SceneConfig, delay: str, lanes: int = 256) -> DataFrame:
    """The batch ticks from a stream: latest report per aircraft at each tick, no older than the staleness bound.

    Reports carry `t0_us`, the start of the grid of their airport and day. A tick is released once the watermark has passed
    it, so `delay` is how late a report may come. The grid of an aircraft goes on until its last report is too old.
    A state key is one of `lanes` lanes of aircraft of a day.
    """
    fields = [*DAY, "aircraft_id", "t0_us", "timestamp_us", "source_file_id", *STATE]
    # A filter on the event time stays above the watermark, so the end marker moves the watermark only.
    real = reports.withWatermark("event_time", delay).filter(F.col("event_time") < F.timestamp_micros(F.lit(END_US)))
    kept = real.select(*fields, "event_time", _lane(lanes)).groupBy(*DAY, "lane", "t0_us")
    schema = "airport_id string, source_day string, aircraft_id string, t0_us long, k long, timestamp_us long, source_file_id string, "
    return kept.transformWithStateInPandas(
        TickKeeper(cfg.step_us, cfg.stale_us), schema + ", ".join(f"{c} double" for c in STATE), "append", "eventTime"
    )


def matured_labels(cutoffs: DataFrame, pairs: DataFrame, cfg: SceneConfig, delay: str) -> DataFrame:
    """Onset labels of cutoffs, each joined to its future and released once its longest horizon has passed.

    Cutoffs are (airport, day, k, timestamp_us); `pairs` are the active pairs of a tick with the older report time of the pair
    there (`older_us`) and, where it was active one tick before, at that tick (`older_prev`); a row may stand for `n` pairs. An interval join with watermarks on
    both sides holds a cutoff until its horizon has passed; one without onsets comes out with zeros. Cutoffs are cut into spans of
    one horizon, and a pair goes to the two spans it can count for, so a day is many keys.
    """
    longest = max(cfg.horizons_us)
    steps = cfg.horizon_steps(longest)
    left = cutoffs.withWatermark("event_time", delay).select(
        *DAY, "k", F.col("timestamp_us").alias("cutoff_us"), F.col("event_time").alias("cutoff_time"), F.floor(F.col("k") / steps).alias("span")
    )
    spans = F.sequence(F.floor((F.col("k") - steps) / steps), F.floor((F.col("k") - 1) / steps))
    right = pairs.withWatermark("event_time", delay).select(
        *[F.col(c).alias(f"r_{c}") for c in DAY], F.col("k").alias("r_k"), F.col("timestamp_us").alias("tick_us"),
        F.col("event_time").alias("tick_time"), "older_us", "older_prev",
        (F.col("n") if "n" in pairs.columns else F.lit(1).cast("long")).alias("n"), F.explode(spans).alias("r_span"),
    )
    follows = (
        (F.col("tick_time") > F.col("cutoff_time"))
        & (F.col("tick_time") <= F.col("cutoff_time") + F.expr(f"INTERVAL {longest // 1_000_000} SECONDS"))
    )
    # At the tick after the cutoff the tick before is the cutoff itself: a pair active there has no onset.
    before = F.col("older_prev").isNotNull() & ((F.col("r_k") == F.col("k") + 1) | (F.col("older_prev") > F.col("cutoff_us")))
    same = (F.col("span") == F.col("r_span")) & (F.col("airport_id") == F.col("r_airport_id")) & (F.col("source_day") == F.col("r_source_day"))
    joined = left.join(right, same & follows & (F.col("older_us") > F.col("cutoff_us")) & ~before, "left_outer")
    started = lambda h: F.sum(F.when(F.col("tick_us") <= F.col("cutoff_us") + h, F.col("n")).otherwise(0))
    counts = [started(h).alias(f"h_{h}") for h in sorted(set(cfg.horizons_us))]
    ended = joined.groupBy(*DAY, "k", "cutoff_us", F.window("cutoff_time", _seconds(cfg.step_us))).agg(*counts)
    labels = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon_us"), F.col(f"h_{h}").alias("onset_events")) for h in sorted(set(cfg.horizons_us))])
    return ended.select(*DAY, "k", "cutoff_us", F.explode(labels).alias("l")).select(*DAY, "k", "cutoff_us", "l.*")
