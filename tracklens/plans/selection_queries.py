"""Selection, sampling, split and key-lookup queries."""

from pyspark.sql import Window, functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.functions import hashing as H, text
from tracklens.operators import inventory as I, selection as sel, targets as tg, ticks as tk
from tracklens.operators.ordered import blocked_row_number
from tracklens.plans import sql as S
from tracklens.plans.audit_queries import MANIFEST
from tracklens.session import stage_table
from tracklens.sources.tables import event_reports, file_manifest, lineitem_rows, load

QUERIES: dict = {}
ORACLE: dict = {}
SALT = "tracklens-selection"


def _sha(*parts):
    return "sha256(concat(" + ", chr(0), ".join(parts) + "))"


def srt_02_ledger_order(spark, folder):
    """First and last row of every range partition stays in contract order: report the global boundaries per key range."""
    rows = lineitem_rows(spark, folder).select("k1", "k2", "s1", "s2", "s3", "s4")
    ordered = rows.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2", "s1", "s2", "s3", "s4")
    return ordered.groupBy((F.col("k1") % 50).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "s1")).alias("a"), F.max(F.struct("k1", "k2", "s1")).alias("b")).select(
        "slot", "n", F.col("a.k1").alias("first_k1"), F.col("a.s1").alias("first_s1"), F.col("b.k1").alias("last_k1"), F.col("b.s1").alias("last_s1"))


QUERIES["srt_02_ledger_order"] = srt_02_ledger_order
ORACLE["srt_02_ledger_order"] = f"""WITH {S.LINES}, o AS (SELECT *, k1 % 50 AS slot, row_number() OVER (PARTITION BY k1 % 50 ORDER BY k1, k2, s1) AS a, row_number() OVER (PARTITION BY k1 % 50 ORDER BY k1 DESC, k2 DESC, s1 DESC) AS b FROM lines)
SELECT slot, count(*) AS n, max(k1) FILTER (WHERE a = 1) AS first_k1, max(s1) FILTER (WHERE a = 1) AS first_s1, max(k1) FILTER (WHERE b = 1) AS last_k1, max(s1) FILTER (WHERE b = 1) AS last_s1 FROM o GROUP BY slot"""


def srt_04_first_aircraft(spark, folder):
    ticks = tk.carry_forward(event_reports(spark, folder), CFG)
    rank = Window.partitionBy(*tk.TICK).orderBy("aircraft_id")
    return ticks.withColumn("p", F.row_number().over(rank)).filter("p <= 5").select(*tk.TICK, "aircraft_id")


QUERIES["srt_04_first_aircraft"] = srt_04_first_aircraft
ORACLE["srt_04_first_aircraft"] = f"WITH {S.TICKS} SELECT airport_id, source_day, k, aircraft_id FROM ticks QUALIFY row_number() OVER (PARTITION BY source_day, k ORDER BY aircraft_id) <= 5"


def srt_05_hash_top(spark, folder):
    rows = load(spark, folder, "customer").select("c_mktsegment", F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("block_id"))
    return sel.top_by_hash(rows, ["c_mktsegment"], "block_id", 7, SALT)


QUERIES["srt_05_hash_top"] = srt_05_hash_top
ORACLE["srt_05_hash_top"] = f"""SELECT c_mktsegment, concat('b', c_custkey) AS block_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_sha(f"'{SALT}'", "concat('b', c_custkey)")}) <= 7"""


def srt_06_ranked_sources(spark, folder):
    files = I.eligible_sources(file_manifest(spark, folder)).withColumn("row_count", F.col("size_bytes") % 50)
    return sel.top_sources(files, "airport_id", "row_count", "relative_path", 25, SALT).select("airport_id", "relative_path", "row_count", F.col("rank").cast("long").alias("rank"))


QUERIES["srt_06_ranked_sources"] = srt_06_ranked_sources
ORACLE["srt_06_ranked_sources"] = f"""WITH {MANIFEST} SELECT airport_id, relative_path, size_bytes % 50 AS row_count, row_number() OVER (PARTITION BY airport_id ORDER BY size_bytes % 50 DESC, {_sha(f"'{SALT}'", 'relative_path')}, relative_path) AS rank
FROM manifest WHERE extension = '.csv' AND disposition IN ('include', 'drop_terminal_record') AND size_bytes % 50 > 0 QUALIFY rank <= 25"""


def win_14_best_per_stratum(spark, folder):
    files = file_manifest(spark, folder).withColumn("date", F.date_format(text.token_date(F.col("date_directory")), "yyyy-MM-dd"))
    quarter = F.concat(F.substring("date", 1, 4), F.lit("Q"), F.quarter(F.col("date").cast("date")).cast("string"))
    return sel.best_per_stratum(files.withColumn("stratum", quarter), ["airport_id", "stratum"], "size_bytes", "date", "relative_path")


QUERIES["win_14_best_per_stratum"] = win_14_best_per_stratum
ORACLE["win_14_best_per_stratum"] = f"""WITH {MANIFEST} SELECT airport_id, concat(year, 'Q', quarter(d)) AS stratum, size_bytes, CAST(d AS VARCHAR) AS date, relative_path FROM manifest
QUALIFY row_number() OVER (PARTITION BY airport_id, stratum ORDER BY size_bytes DESC, date DESC, relative_path DESC) = 1"""


def _strata(spark, folder):
    rows = load(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("airport"), F.col("c_nationkey").alias("stratum")).agg(F.count(F.lit(1)).alias("population"))
    total = F.expr("CAST(sum(population) OVER (PARTITION BY airport) * 2 div 5 AS BIGINT)")
    return rows.withColumn("total", total).withColumn("capacity", F.col("population"))


_HAM = "hs AS (SELECT c_mktsegment AS airport, c_nationkey AS stratum, count(*) AS population FROM customer GROUP BY ALL), ht AS (SELECT *, CAST(sum(population) OVER (PARTITION BY airport) AS BIGINT) AS whole FROM hs)"


def smp_01_apportion(spark, folder):
    return sel.apportion(_strata(spark, folder), "airport", "stratum").select("airport", F.col("stratum").cast("long").alias("stratum"), "population", "allocated")


QUERIES["smp_01_apportion"] = smp_01_apportion
ORACLE["smp_01_apportion"] = f"""WITH {_HAM}, a AS (SELECT *, whole * 2 // 5 AS total FROM ht), b AS (SELECT *, total * population // whole AS fl, total * population % whole AS rest FROM a),
 c AS (SELECT *, total - sum(fl) OVER (PARTITION BY airport) AS remaining, row_number() OVER (PARTITION BY airport ORDER BY rest DESC, stratum) AS r FROM b)
SELECT airport, CAST(stratum AS BIGINT) AS stratum, population, CAST(fl + CASE WHEN r <= remaining THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM c"""


def smp_02_stratum_quotas(spark, folder):
    return sel.stratum_quotas(_strata(spark, folder), "airport", "stratum").select("airport", F.col("stratum").cast("long").alias("stratum"), "population", "quota")


QUERIES["smp_02_stratum_quotas"] = smp_02_stratum_quotas
ORACLE["smp_02_stratum_quotas"] = f"""WITH {_HAM}, a AS (SELECT *, whole * 2 // 5 - count(*) OVER (PARTITION BY airport) AS total FROM ht), b AS (SELECT *, total * population // whole AS fl, total * population % whole AS rest FROM a),
 c AS (SELECT *, total - sum(fl) OVER (PARTITION BY airport) AS remaining, row_number() OVER (PARTITION BY airport ORDER BY CASE WHEN fl < population - 1 THEN 0 ELSE 1 END, rest DESC, stratum) AS r FROM b)
SELECT airport, CAST(stratum AS BIGINT) AS stratum, population, CAST(1 + fl + CASE WHEN r <= remaining THEN 1 ELSE 0 END AS BIGINT) AS quota FROM c"""


def smp_03_covering_prefix(spark, folder):
    files = I.eligible_sources(file_manifest(spark, folder)).withColumn("row_count", F.col("size_bytes") % 100).withColumn("quota", F.lit(5000))
    return sel.covering_prefix(files, "airport_id", "relative_path", "row_count", "quota", SALT).select("airport_id", "relative_path", "row_count", "covered")


QUERIES["smp_03_covering_prefix"] = smp_03_covering_prefix
ORACLE["smp_03_covering_prefix"] = f"""WITH {MANIFEST}, c AS (SELECT airport_id, relative_path, size_bytes % 100 AS row_count, CAST(sum(size_bytes % 100) OVER (PARTITION BY airport_id ORDER BY {_sha(f"'{SALT}'", 'relative_path')}, relative_path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered
 FROM manifest WHERE extension = '.csv' AND disposition IN ('include', 'drop_terminal_record')) SELECT * FROM c WHERE covered - row_count < 5000"""


def smp_04_systematic(spark, folder):
    """Each order's lines are a small population; the quota is a third of it, rounded up."""
    rows = lineitem_rows(spark, folder)
    order = Window.partitionBy("k1").orderBy("k2", "s1", "s2", "s3", "s4")
    sized = rows.withColumn("ordinal", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k1")))
    quota = F.expr("(n + 2) div 3")
    return sized.filter(sel.systematic_midpoint(F.col("ordinal").cast("long"), F.col("n"), quota)).select("k1", F.col("ordinal").cast("long").alias("ordinal"), "n", quota.alias("quota"), "s1")


QUERIES["smp_04_systematic"] = smp_04_systematic
ORACLE["smp_04_systematic"] = f"""WITH {S.LINES}, o AS (SELECT k1, s1, row_number() OVER (PARTITION BY k1 ORDER BY k2, s1, s2, s3, s4) AS ordinal, count(*) OVER (PARTITION BY k1) AS n FROM lines),
 p AS (SELECT k1, max(n) AS n, (max(n) + 2) // 3 AS quota FROM o GROUP BY k1), j AS (SELECT k1, n, quota, unnest(range(0, quota)) AS j FROM p)
SELECT o.k1, o.ordinal, o.n, j.quota, o.s1 FROM j JOIN o ON o.k1 = j.k1 AND o.ordinal = (2 * j.j + 1) * j.n // (2 * j.quota) + 1"""


def smp_05_stratified_sample(spark, folder):
    labels = tg.scene_targets(stage_table(tk.carry_forward(event_reports(spark, folder), CFG), "ticks"), CFG, separations=False).filter("horizon_s = 120")
    scenes = labels.select(F.concat_ws("|", "airport_id", "source_day", F.col("cutoff_us").cast("string")).alias("scene_id"), (F.col("onset_events") > 0).alias("positive"))
    rank = Window.partitionBy("positive").orderBy(F.sha2("scene_id", 256), "scene_id")
    return scenes.withColumn("r", F.row_number().over(rank)).filter("r <= 12").select("scene_id", "positive")


QUERIES["smp_05_stratified_sample"] = smp_05_stratified_sample
ORACLE["smp_05_stratified_sample"] = f"""WITH {S.TARGETS}, s AS (SELECT concat_ws('|', airport_id, source_day, cutoff_us) AS scene_id, onset_events > 0 AS positive FROM targets WHERE horizon_s = 120)
SELECT scene_id, positive FROM s QUALIFY row_number() OVER (PARTITION BY positive ORDER BY sha256(scene_id), scene_id) <= 12"""

_SPLIT = "CASE WHEN i < greatest(1, n * 60 // 100) THEN 'train' WHEN i < least(greatest(greatest(1, n * 60 // 100) + CASE WHEN n >= 3 THEN 1 ELSE 0 END, n * 80 // 100), n) THEN 'validation' ELSE 'test' END"


def spl_01_group_splits(spark, folder):
    days = event_reports(spark, folder).select(F.concat(F.lit("P"), (F.col("event_id") % 2).cast("string")).alias("airport_id"), "source_day")
    return sel.group_splits(days, ["airport_id"], "source_day", SALT)


QUERIES["spl_01_group_splits"] = spl_01_group_splits
ORACLE["spl_01_group_splits"] = f"""WITH d AS (SELECT DISTINCT concat('P', event_id % 2) AS airport_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS source_day FROM events),
 r AS (SELECT *, count(*) OVER (PARTITION BY airport_id) AS n, row_number() OVER (PARTITION BY airport_id ORDER BY {_sha(f"'{SALT}'", 'airport_id', 'source_day')}, source_day) - 1 AS i FROM d) SELECT airport_id, source_day, {_SPLIT} AS split FROM r"""


def spl_02_entity_split(spark, folder):
    c = load(spark, folder, "customer").select(F.col("c_name").alias("entity"))
    return c.withColumn("split", sel.entity_split(F.col("entity"), SALT))


QUERIES["spl_02_entity_split"] = spl_02_entity_split
ORACLE["spl_02_entity_split"] = f"""WITH h AS (SELECT c_name AS entity, CAST(CAST(('0x' || substr({_sha(f"'{SALT}'", 'c_name')}, 1, 16)) AS UBIGINT) % 100 AS INT) AS b FROM customer)
SELECT entity, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'validation' ELSE 'test' END AS split FROM h"""


def spl_03_temporal_split(spark, folder):
    e = event_reports(spark, folder)
    start, day = F.lit(1704067200000000), 86_400_000_000
    return e.withColumn("split", sel.temporal_split(F.col("timestamp_us"), start + 18 * day, start + 24 * day, F.lit(day // 2))).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))


QUERIES["spl_03_temporal_split"] = spl_03_temporal_split
ORACLE["spl_03_temporal_split"] = """WITH e AS (SELECT epoch_us(ts) AS t, 1704067200000000 + 18 * 86400000000 AS a, 1704067200000000 + 24 * 86400000000 AS b, 43200000000 AS g FROM events)
SELECT CASE WHEN t < a - g THEN 'train' WHEN t > a + g AND t < b - g THEN 'validation' WHEN t > b + g THEN 'test' END AS split, count(*) AS n, min(t) AS first_us, max(t) AS last_us FROM e GROUP BY 1"""


def spl_04_sequential_splits(spark, folder):
    files = I.ordered_sources(I.eligible_sources(file_manifest(spark, folder)))
    return sel.sequential_splits(files, "airport_id", ["source_sequence", "relative_path"]).groupBy("airport_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("source_sequence").alias("first"), F.max("source_sequence").alias("last"))


QUERIES["spl_04_sequential_splits"] = spl_04_sequential_splits
ORACLE["spl_04_sequential_splits"] = f"""WITH {MANIFEST}, s AS (SELECT airport_id, row_number() OVER (PARTITION BY airport_id ORDER BY d, stem, extension, relative_path) - 1 AS i, count(*) OVER (PARTITION BY airport_id) AS n FROM manifest
  WHERE extension = '.csv' AND disposition IN ('include', 'drop_terminal_record')), t AS (SELECT *, greatest(1, 3 * n // 5) AS te FROM s)
SELECT airport_id, CASE WHEN i < te THEN 'train' WHEN i < least(greatest(te + 1, 4 * n // 5), n - 1) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(i) AS first, max(i) AS last FROM t GROUP BY ALL"""


def spl_05_crossing(spark, folder):
    """Reports split by report instead of by aircraft leave aircraft on several sides; the check lists them."""
    rows = event_reports(spark, folder).withColumn("split", sel.entity_split(F.col("event_id").cast("string"), SALT))
    return sel.crossing_identifiers(rows, "aircraft_id")


QUERIES["spl_05_crossing"] = spl_05_crossing
ORACLE["spl_05_crossing"] = f"""WITH {S.REPORTS}, h AS (SELECT aircraft_id, CAST(CAST(('0x' || substr({_sha(f"'{SALT}'", 'CAST(event_id AS VARCHAR)')}, 1, 16)) AS UBIGINT) % 100 AS INT) AS b FROM reports)
SELECT aircraft_id FROM h GROUP BY aircraft_id HAVING count(DISTINCT CASE WHEN b < 60 THEN 1 WHEN b < 80 THEN 2 ELSE 3 END) > 1"""


def win_10_track_deltas(spark, folder):
    d = sel.track_deltas(event_reports(spark, folder), ["airport_id", "aircraft_id", "source_day"], "timestamp_us", ["lat_deg", "altitude_m", "speed_mps"])
    return d.select("event_id", F.round("track_dt_s", 6).alias("dt_s"), F.round("track_dlat_deg", 6).alias("dlat"), "track_daltitude_m", "track_dspeed_mps")


QUERIES["win_10_track_deltas"] = win_10_track_deltas
ORACLE["win_10_track_deltas"] = f"""WITH {S.REPORTS} SELECT event_id, round((timestamp_us - lag(timestamp_us) OVER w) / 1000000.0, 6) AS dt_s, round(lat_deg - lag(lat_deg) OVER w, 6) AS dlat,
 altitude_m - lag(altitude_m) OVER w AS track_daltitude_m, speed_mps - lag(speed_mps) OVER w AS track_dspeed_mps FROM reports WINDOW w AS (PARTITION BY airport_id, aircraft_id, source_day ORDER BY timestamp_us)"""


def win_15_masked_spans(spark, folder):
    m = sel.masked_spans(event_reports(spark, folder), ["source_day", "aircraft_id"], ["timestamp_us"], 1701, SALT, ["source_day"])
    return m.select("event_id", F.col("span").cast("long").alias("span"), "masked")


QUERIES["win_15_masked_spans"] = win_15_masked_spans
ORACLE["win_15_masked_spans"] = f"""WITH {S.REPORTS}, p AS (SELECT *, count(*) OVER (PARTITION BY source_day, aircraft_id) AS n, row_number() OVER (PARTITION BY source_day, aircraft_id ORDER BY timestamp_us) - 1 AS i FROM reports),
 s AS (SELECT *, i // 4 - CASE WHEN n % 4 = 1 AND n > 4 AND i = n - 1 THEN 1 ELSE 0 END AS span FROM p),
 h AS (SELECT *, CASE WHEN n >= 2 THEN {_sha(f"'{SALT}'", "'1701'", 'source_day', 'aircraft_id', 'CAST(span AS VARCHAR)')} END AS hs FROM s), l AS (SELECT *, min(hs) OVER (PARTITION BY source_day) AS least FROM h)
SELECT event_id, span, coalesce(CASE WHEN substr(least, 1, 16) < '4ccccccccccccccc' THEN substr(hs, 1, 16) < '4ccccccccccccccc' ELSE hs = least END, false) AS masked FROM l"""


def prj_16_cell_mask(spark, folder):
    fields = F.explode(F.array(F.lit("lat_deg"), F.lit("altitude_m"), F.lit("speed_mps"))).alias("field")
    cells = event_reports(spark, folder).select("event_id", fields)
    return cells.groupBy("field").agg(F.count(F.lit(1)).alias("cells"), F.count_if(H.cell_mask(1701, F.col("event_id").cast("string"), F.col("field"))).alias("masked"))


QUERIES["prj_16_cell_mask"] = prj_16_cell_mask
ORACLE["prj_16_cell_mask"] = f"""SELECT field, count(*) AS cells, count(*) FILTER (WHERE substr({_sha("'1701'", 'CAST(event_id AS VARCHAR)', 'field')}, 1, 16) < '4ccccccccccccccc') AS masked
FROM events CROSS JOIN (SELECT unnest(['lat_deg', 'altitude_m', 'speed_mps']) AS field) GROUP BY ALL"""


def join_14_next_row(spark, folder):
    return sel.next_row(event_reports(spark, folder), ["airport_id", "source_day", "aircraft_id"], ["timestamp_us"], "event_id", "next_event_id").select("event_id", "next_event_id")


QUERIES["join_14_next_row"] = join_14_next_row
ORACLE["join_14_next_row"] = f"WITH {S.REPORTS} SELECT event_id, lead(event_id) OVER (PARTITION BY airport_id, source_day, aircraft_id ORDER BY timestamp_us) AS next_event_id FROM reports"


def _window_scenes(spark, folder):
    rows = event_reports(spark, folder).select("airport_id", "source_file_id", "aircraft_id", "timestamp_us", "event_id", "altitude_m")
    return sel.window_scenes(rows, CFG.step_us * 6, 3, 12)


_WINDOWS = S.REPORTS + f""", wl AS (SELECT airport_id, source_file_id, timestamp_us // {S.STEP * 6} AS bucket, aircraft_id, timestamp_us, event_id FROM reports
  QUALIFY row_number() OVER (PARTITION BY airport_id, source_file_id, bucket, aircraft_id ORDER BY timestamp_us DESC, event_id DESC) = 1),
 wn AS (SELECT *, count(*) OVER (PARTITION BY airport_id, source_file_id, bucket) AS n_aircraft FROM wl),
 ws AS (SELECT * FROM wn WHERE n_aircraft >= 3 QUALIFY row_number() OVER (PARTITION BY airport_id, source_file_id, bucket ORDER BY sha256(concat(airport_id, chr(0), source_file_id, chr(0), bucket, chr(0), aircraft_id)), aircraft_id) <= 12)"""


def str_03_window_scenes_batch(spark, folder):
    return _window_scenes(spark, folder).select("airport_id", "source_file_id", "bucket", "aircraft_id", "n_aircraft", "event_id")


QUERIES["str_03_window_scenes_batch"] = str_03_window_scenes_batch
ORACLE["str_03_window_scenes_batch"] = f"WITH {_WINDOWS} SELECT airport_id, source_file_id, bucket, aircraft_id, n_aircraft, event_id FROM ws"


def join_13_scene_transitions(spark, folder):
    return sel.scene_transitions(_window_scenes(spark, folder)).select("airport_id", "source_file_id", "bucket", "aircraft_id", "timestamp_us", "next_us")


QUERIES["join_13_scene_transitions"] = join_13_scene_transitions
ORACLE["join_13_scene_transitions"] = f"""WITH {_WINDOWS} SELECT a.airport_id, a.source_file_id, a.bucket, a.aircraft_id, a.timestamp_us, b.timestamp_us AS next_us FROM ws a JOIN ws b
 ON a.airport_id = b.airport_id AND a.source_file_id = b.source_file_id AND a.aircraft_id = b.aircraft_id AND b.bucket = a.bucket + 1"""


def agg_23_densest_bucket(spark, folder):
    buckets = event_reports(spark, folder).groupBy("airport_id", "source_file_id", "source_day", F.floor(F.col("timestamp_us") / F.lit(10 * CFG.step_us)).alias("bucket")).agg(
        F.countDistinct("aircraft_id").alias("aircraft"), F.count(F.lit(1)).alias("n_rows"))
    best = buckets.groupBy("airport_id", "source_file_id", "source_day").agg(F.min(F.struct((-F.col("aircraft")).alias("a"), (-F.col("n_rows")).alias("n"), "bucket")).alias("b"))
    return best.select("airport_id", "source_file_id", "source_day", F.col("b.bucket").alias("bucket"), (-F.col("b.a")).alias("aircraft"), (-F.col("b.n")).alias("n_rows"))


QUERIES["agg_23_densest_bucket"] = agg_23_densest_bucket
ORACLE["agg_23_densest_bucket"] = f"""WITH {S.REPORTS}, b AS (SELECT airport_id, source_file_id, source_day, timestamp_us // {10 * S.STEP} AS bucket, count(DISTINCT aircraft_id) AS aircraft, count(*) AS n_rows FROM reports GROUP BY ALL)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY airport_id, source_file_id, source_day ORDER BY aircraft DESC, n_rows DESC, bucket) = 1"""


def join_05_horizon_ticks(spark, folder):
    """Visible aircraft after each cutoff by horizon, from per-tick counts and range frames instead of a range join."""
    ticks = tk.carry_forward(event_reports(spark, folder), CFG)
    counts = ticks.groupBy(*tk.TICK).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*tk.DAY).orderBy("k")
    names = {f"seen_{h}s": h * 60_000_000 // CFG.step_us for h in (30, 120, 300)}
    framed = counts.withColumns({n: F.coalesce(F.sum("n").over(order.rangeBetween(1, s)), F.lit(0)) for n, s in names.items()})
    return tk.eligible_cutoffs(ticks, CFG).select(*tk.TICK).join(framed, tk.TICK).select(*tk.TICK, *names)


QUERIES["join_05_horizon_ticks"] = join_05_horizon_ticks
ORACLE["join_05_horizon_ticks"] = f"""WITH {S.TICKS}{S.SCENES} SELECT s.airport_id, s.source_day, s.c AS k, count(*) FILTER (WHERE t.k <= s.c + 3) AS seen_30s, count(*) FILTER (WHERE t.k <= s.c + 12) AS seen_120s,
 count(t.k) AS seen_300s FROM scenes s LEFT JOIN ticks t ON t.source_day = s.source_day AND t.k > s.c AND t.k <= s.c + 30 GROUP BY ALL"""


def join_09_merge_sorted(spark, folder):
    """Three sorted runs of one ledger brought together in key order, with each key's origin runs."""
    rows = lineitem_rows(spark, folder).withColumn("run", F.col("s1") % 3)
    return rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("run").cast("string"))), ",").alias("runs"))


QUERIES["join_09_merge_sorted"] = join_09_merge_sorted
ORACLE["join_09_merge_sorted"] = f"WITH {S.LINES} SELECT k1, k2, count(*) AS n, string_agg(DISTINCT CAST(s1 % 3 AS VARCHAR), ',' ORDER BY CAST(s1 % 3 AS VARCHAR)) AS runs FROM lines GROUP BY k1, k2"


def join_10_by_row_id(spark, folder):
    """Rows and their ranks, computed apart, meet on the row identity instead of by position."""
    rows = lineitem_rows(spark, folder)
    identity = ["k1", "k2", "s1", "s2", "s3", "s4"]
    ranks = rows.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*identity[2:]))).select(*identity, "r")
    return rows.join(ranks, identity).groupBy(F.col("r").cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.count("age_s").alias("aged"))


QUERIES["join_10_by_row_id"] = join_10_by_row_id
ORACLE["join_10_by_row_id"] = f"WITH {S.LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY s1, s2, s3, s4) AS r FROM lines) SELECT r, count(*) AS n, count(age_s) AS aged FROM o GROUP BY r"


def join_12_scene_groups(spark, folder):
    """Scenes list their source files; each must lead to exactly one frozen group."""
    windows = _window_scenes(spark, folder).withColumn("slot", F.floor(F.col("bucket") / 4))
    scenes = windows.groupBy("slot").agg(F.array_sort(F.collect_set("source_file_id")).alias("sources"))
    groups = load(spark, folder, "events").select(F.concat(F.lit("S"), (F.col("event_id") % 2).cast("string")).alias("source"), F.lit("early").alias("grp")).distinct()
    bound = scenes.select("slot", F.explode("sources").alias("source")).join(groups, "source").groupBy("slot").agg(F.count_distinct("grp").alias("groups"), F.min("grp").alias("grp"))
    return scenes.select("slot", F.size("sources").cast("long").alias("n_sources")).join(bound, "slot", "left").select("slot", "n_sources", F.coalesce("groups", F.lit(0)).alias("groups"), "grp")


QUERIES["join_12_scene_groups"] = join_12_scene_groups
ORACLE["join_12_scene_groups"] = f"""WITH {_WINDOWS}, s AS (SELECT bucket // 4 AS slot, count(DISTINCT source_file_id) AS n_sources, max(CASE WHEN source_file_id IN ('S0', 'S1') THEN 1 ELSE 0 END) AS groups FROM ws GROUP BY ALL)
SELECT slot, n_sources, CAST(groups AS BIGINT) AS groups, CASE WHEN groups = 1 THEN 'early' END AS grp FROM s"""


def join_16_airport_centers(spark, folder):
    """Supplier balances per nation name through a dimension lookup; the planner picks the join by size."""
    s, n = load(spark, folder, "supplier"), load(spark, folder, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


QUERIES["join_16_airport_centers"] = join_16_airport_centers
ORACLE["join_16_airport_centers"] = "SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"


def set_03_new_pairs(spark, folder):
    """Active pairs of a tick that were not active one tick earlier."""
    active = tg.active_pairs(tk.carry_forward(event_reports(spark, folder), CFG), CFG, previous=True)
    return active.filter("older_prev IS NULL").select(*tk.TICK, "a_id", "b_id")


QUERIES["set_03_new_pairs"] = set_03_new_pairs
ORACLE["set_03_new_pairs"] = f"WITH {S.PAIRS} SELECT airport_id, source_day, k, a_id, b_id FROM act EXCEPT SELECT airport_id, source_day, k + 1, a_id, b_id FROM act"


def set_04_common_days(spark, folder):
    o, l = load(spark, folder, "orders"), load(spark, folder, "lineitem")
    a = o.filter("o_orderstatus = 'F'").select(F.expr("CAST(CAST(o_orderdate AS DATE) AS STRING)").alias("day"))
    b = l.filter("l_returnflag = 'R'").select(F.expr("CAST(CAST(l_shipdate AS DATE) AS STRING)").alias("day"))
    return a.intersect(b)


QUERIES["set_04_common_days"] = set_04_common_days
ORACLE["set_04_common_days"] = "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R'"


def set_05_ofat_settings(spark, folder):
    """Active pairs under the one-factor-at-a-time settings; one pass over the pairs serves all."""
    from tracklens.operators.evaluate import ofat_settings

    ticks = tk.carry_forward(event_reports(spark, folder), CFG)
    settings = ofat_settings((3, 5, 7), (500, 1000, 1500), 5, 1000)
    ages = tg.pair_ages(ticks, CFG, [(h, v) for _, h, v in settings], previous=False, reach=True)
    counted = ages.groupBy("airport_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("setting") == i, F.col("n"))), F.lit(0)).alias(name) for i, (name, _, _) in enumerate(settings)])
    return counted.unpivot("airport_id", [name for name, _, _ in settings], "setting", "active_pair_ticks")


QUERIES["set_05_ofat_settings"] = set_05_ofat_settings
ORACLE["set_05_ofat_settings"] = f"""WITH {S.PAIRS}, st AS (SELECT * FROM (VALUES ('h3nm_v1000ft', 3 * 1852.0, 304.8), ('h5nm_v500ft', 5 * 1852.0, 152.4), ('h5nm_v1000ft', 5 * 1852.0, 304.8), ('h5nm_v1500ft', 5 * 1852.0, 457.2), ('h7nm_v1000ft', 7 * 1852.0, 304.8)) AS t(setting, h, v))
SELECT airport_id, setting, count(*) FILTER (WHERE p.h_m < st.h AND p.v_m < st.v) AS active_pair_ticks FROM pairs p CROSS JOIN st GROUP BY ALL"""


def fn_09_digests(spark, folder):
    rows = lineitem_rows(spark, folder).select("k1", "k2", "s1", "tail")
    doc = H.canonical_json({"tail": F.col("tail"), "k1": F.col("k1"), "s1": F.when(F.col("s1") % 2 == 0, F.col("s1"))})
    return rows.groupBy(F.col("k1").alias("k1")).agg(F.min(F.sha2(doc, 256)).alias("least_digest"), F.max(doc).alias("last_doc"))


QUERIES["fn_09_digests"] = fn_09_digests
ORACLE["fn_09_digests"] = f"""WITH {S.LINES}, d AS (SELECT k1, concat('{{"k1":', k1, ',"s1":', CASE WHEN s1 % 2 = 0 THEN CAST(s1 AS VARCHAR) ELSE '{{"type":"null"}}' END, ',"tail":"', tail, '"}}') AS doc FROM lines)
SELECT k1, min(sha256(doc)) AS least_digest, max(doc) AS last_doc FROM d GROUP BY k1"""


def fn_10_hash_buckets(spark, folder):
    c = load(spark, folder, "customer").select("c_name", F.sha2("c_name", 256).alias("d"))
    return c.select("c_name", H.prefix_mod(F.col("d"), 256).alias("bucket"), H.digest_mod(F.col("d"), 256).alias("shard"))


QUERIES["fn_10_hash_buckets"] = fn_10_hash_buckets
ORACLE["fn_10_hash_buckets"] = """SELECT c_name, CAST(CAST(('0x' || substr(sha256(c_name), 1, 16)) AS UBIGINT) % 256 AS BIGINT) AS bucket, CAST(('0x' || substr(sha256(c_name), 63, 2)) AS BIGINT) AS shard FROM customer"""


def snk_04_content_digest(spark, folder):
    return H.content_digest(lineitem_rows(spark, folder))


QUERIES["snk_04_content_digest"] = snk_04_content_digest


def snk_04_content_root(spark, folder):
    """Order-sensitive root of each tail's rows in the order of their natural key and place of supply."""
    rows = lineitem_rows(spark, folder).select("tail", "k1", "k2", "s1", "s2")
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("k1", "k2", "s1", "s2")])
    order = ["k1", "k2", "s1", "s2"]
    placed = blocked_row_number(rows, ["tail"], F.floor(F.col("k1") / 8_192), order, "at").withColumn("at", F.col("at") - 1)
    return H.content_root(placed, ["tail"], "at", text)


QUERIES["snk_04_content_root"] = snk_04_content_root
_ROOT = [f"list_reduce(list_prepend(0::HUGEINT, list(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)::HUGEINT ORDER BY k1 DESC, k2 DESC, s1 DESC, s2 DESC)), lambda a, x: (a * {H.ROOT_BASE} + x) % {p})" for i, p in enumerate(H.ROOT_PRIMES)]
ORACLE["snk_04_content_root"] = f"""WITH {S.LINES}, d AS (SELECT tail, k1, k2, s1, s2, sha256(concat_ws('|', k1, k2, s1, s2)) AS d FROM lines)
SELECT tail, count(*) AS row_count, concat({_ROOT[0].join(("lpad(lower(hex(CAST(", " AS BIGINT))), 8, '0')"))}, '-', {_ROOT[1].join(("lpad(lower(hex(CAST(", " AS BIGINT))), 8, '0')"))}) AS content_root FROM d GROUP BY tail"""


def src_14_column_scan(spark, folder):
    return load(spark, folder, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ'1997-01-01'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last_key"))


QUERIES["src_14_column_scan"] = src_14_column_scan
ORACLE["src_14_column_scan"] = "SELECT l_returnflag, count(*) AS n, max(l_orderkey) AS last_key FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY l_returnflag"
