"""Evaluation queries: scored line items, scene indicators and labels."""

from functools import reduce

from pyspark.sql import functions as F

from tracklens.config import EVENT_CONFIG as CFG
from tracklens.functions import stats as st
from tracklens.operators import evaluate as ev, features as ft, targets as tg, ticks as tk
from tracklens.operators.ordered import exact_quantiles
from tracklens.plans import sql as S
from tracklens.plans.audit_queries import MANIFEST
from tracklens.plans.feature_queries import INDICATORS, NAMES
from tracklens.session import stage_table
from tracklens.sources.tables import event_reports, file_manifest, load, prediction_rows

QUERIES: dict = {}
ORACLE: dict = {}

PRED = """pred AS (SELECT *, greatest(0.0, raw_b) AS count_b FROM (SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'AP2' ELSE 'AP1' END AS airport, strftime(l_shipdate, '%Y-%m') AS grp,
  concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS scene_id, epoch_us(l_shipdate) AS cutoff_us, CAST(CASE l_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 120 ELSE 300 END AS BIGINT) AS horizon,
  CAST(l_quantity AS BIGINT) % 8 AS y, CAST(CASE WHEN CAST(l_quantity AS BIGINT) % 8 >= 3 THEN 1 ELSE 0 END AS BIGINT) AS risk, l_partkey % 11 + 1 AS pair_opportunity, CAST(l_linenumber + 2 AS BIGINT) AS n_aircraft,
  CAST((CAST(l_quantity AS BIGINT) % 8) * 100 + l_suppkey % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob_b, CAST((CAST(l_quantity AS BIGINT) % 8) * 10 + l_partkey % 17 - 8 AS DOUBLE) / CAST(10 AS DOUBLE) AS raw_b,
  CAST(l_partkey % 70 AS DOUBLE) / CAST(10 AS DOUBLE) AS count_a, CAST(l_suppkey % 25 AS DOUBLE) AS max_report_age_s FROM lineitem))"""
KEYS = ["airport", "horizon"]


def _pred(spark, folder):
    return prediction_rows(spark, folder)


def _r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def agg_32_exposure_rate(spark, folder):
    rows = _pred(spark, folder)
    fit = ev.exposure_rate(rows.filter("grp < '1998-01'"), ["horizon"], "y", "pair_opportunity")
    scored = rows.filter("grp >= '1998-01'").join(fit, "horizon").withColumn("p", F.col("rate") * F.col("pair_opportunity"))
    return _r(scored.groupBy("horizon", "pair_opportunity").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("prediction")), 8, "prediction")


QUERIES["agg_32_exposure_rate"] = agg_32_exposure_rate
ORACLE["agg_32_exposure_rate"] = f"""WITH {PRED}, f AS (SELECT horizon, CASE WHEN sum(pair_opportunity) > 0 THEN sum(y) / sum(pair_opportunity) ELSE avg(y) END AS rate FROM pred WHERE grp < '1998-01' GROUP BY horizon)
SELECT p.horizon, pair_opportunity, count(*) AS n, round(max(rate * pair_opportunity), 8) AS prediction FROM pred p JOIN f ON f.horizon = p.horizon WHERE grp >= '1998-01' GROUP BY ALL"""


def agg_33_prevalence(spark, folder):
    return _r(ev.prevalence(_pred(spark, folder), KEYS, "risk"), 10, "prevalence")


QUERIES["agg_33_prevalence"] = agg_33_prevalence
ORACLE["agg_33_prevalence"] = f"WITH {PRED} SELECT airport, horizon, round(avg(risk), 10) AS prevalence FROM pred GROUP BY ALL"


def _losses(spark, folder, metric="mae", truth="y", cand="count_b", ref="count_a"):
    return ev.group_losses(_pred(spark, folder), KEYS, "grp", truth, cand, ref, metric)


def agg_34_equal_group(spark, folder):
    return _r(ev.equal_group_comparison(_losses(spark, folder), KEYS, 1e-9), 8, "candidate_equal_group_mean", "reference_equal_group_mean", "candidate_minus_reference", "sign_p")


QUERIES["agg_34_equal_group"] = agg_34_equal_group
_GL = PRED + ", gl AS (SELECT airport, horizon, grp, avg(abs(count_b - y)) AS c, avg(abs(count_a - y)) AS r FROM pred GROUP BY ALL)"
_WL = "count(*) FILTER (WHERE c - r < -1e-9) AS w, count(*) FILTER (WHERE c - r > 1e-9) AS l"
_SIGN = "CASE WHEN w + l = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2))))) END"
ORACLE["agg_34_equal_group"] = f"""WITH {_GL}, s AS (SELECT airport, horizon, count(*) AS group_count, avg(c) AS cm, avg(r) AS rm, avg(c - r) AS d, {_WL}, count(*) FILTER (WHERE abs(c - r) <= 1e-9) AS ties FROM gl GROUP BY ALL)
SELECT airport, horizon, group_count, round(cm, 8) AS candidate_equal_group_mean, round(rm, 8) AS reference_equal_group_mean, round(d, 8) AS candidate_minus_reference, w AS candidate_wins, l AS reference_wins, ties, round({_SIGN}, 8) AS sign_p FROM s"""


def agg_35_count_metrics(spark, folder):
    return _r(ev.count_metrics(_pred(spark, folder), KEYS, "y", "count_b"), 7, "count_mae", "count_rmse", "mean_poisson_deviance")


QUERIES["agg_35_count_metrics"] = agg_35_count_metrics
ORACLE["agg_35_count_metrics"] = f"""WITH {PRED}, p AS (SELECT *, greatest(count_b, 1e-8) AS m FROM pred) SELECT airport, horizon, round(avg(abs(m - y)), 7) AS count_mae, round(sqrt(avg(pow(m - y, 2))), 7) AS count_rmse,
 round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m))), 7) AS mean_poisson_deviance FROM p GROUP BY ALL"""


def agg_36_probability_metrics(spark, folder):
    return _r(ev.probability_metrics(_pred(spark, folder), KEYS, "risk", "prob_b"), 8, "brier", "log_loss")


QUERIES["agg_36_probability_metrics"] = agg_36_probability_metrics
ORACLE["agg_36_probability_metrics"] = f"""WITH {PRED}, p AS (SELECT *, least(greatest(prob_b, 1e-12), 1 - 1e-12) AS c FROM pred) SELECT airport, horizon, round(avg(pow(prob_b - risk, 2)), 8) AS brier,
 round(-avg(risk * ln(c) + (1 - risk) * ln(1 - c)), 8) AS log_loss FROM p GROUP BY ALL"""


def agg_37_calibration_error(spark, folder):
    return _r(ev.calibration_error(_pred(spark, folder), KEYS, "risk", "prob_b"), 9, "ece")


QUERIES["agg_37_calibration_error"] = agg_37_calibration_error
ORACLE["agg_37_calibration_error"] = f"""WITH {PRED}, b AS (SELECT airport, horizon, least(floor(prob_b * 10), 9) AS bin, count(*) AS n, avg(prob_b) AS p, avg(risk) AS r FROM pred GROUP BY ALL)
SELECT airport, horizon, round(sum(n * abs(p - r)) / sum(n), 9) AS ece FROM b GROUP BY ALL"""


def agg_38_reliability(spark, folder):
    return _r(ev.reliability(_pred(spark, folder), KEYS, "risk", "prob_b", "grp"), 8, "mean_probability", "observed_rate")


QUERIES["agg_38_reliability"] = agg_38_reliability
ORACLE["agg_38_reliability"] = f"""WITH {PRED}, b AS (SELECT airport, horizon, CAST(least(floor(prob_b * 10), 9) AS BIGINT) AS bin, count(*) AS n, count(DISTINCT grp) AS n_groups, avg(prob_b) AS p, avg(risk) AS r FROM pred GROUP BY ALL),
 g AS (SELECT airport, horizon, unnest(range(0, 10)) AS bin FROM (SELECT DISTINCT airport, horizon FROM pred))
SELECT g.airport, g.horizon, g.bin, coalesce(n, 0) AS n, coalesce(n_groups, 0) AS n_groups, round(p, 8) AS mean_probability, round(r, 8) AS observed_rate FROM g LEFT JOIN b ON b.airport = g.airport AND b.horizon = g.horizon AND b.bin = g.bin"""


def agg_39_nb2_loss(spark, folder):
    rows = _pred(spark, folder)
    fit = ev.nb2_dispersion(rows, ["airport"], "y", "count_a")
    scored = rows.join(F.broadcast(fit), "airport")  # one row an airport; a join by airport would deal all rows to as many tasks
    return _r(scored.groupBy("airport", "horizon").agg(
        F.max("dispersion").alias("fitted_dispersion"), F.avg(st.nb2_nll(F.col("y"), F.col("count_a"), F.col("dispersion"))).alias("nb2_nll"),
        F.avg(st.poisson_nll(F.col("y"), F.col("count_a"))).alias("poisson_nll")), 6, "fitted_dispersion", "nb2_nll", "poisson_nll")


QUERIES["agg_39_nb2_loss"] = agg_39_nb2_loss
_NB = "f AS (SELECT airport, greatest(1e-8, sum(pow(y - m, 2) - m) / sum(m * m)) AS a FROM p GROUP BY airport)"
ORACLE["agg_39_nb2_loss"] = f"""WITH {PRED}, p AS (SELECT *, greatest(count_a, 1e-8) AS m FROM pred), {_NB}
SELECT p.airport, horizon, round(max(a), 6) AS fitted_dispersion, round(-avg(lgamma(y + 1/a) - lgamma(1/a) - lgamma(y + 1) + (1/a) * ln((1/a) / (1/a + m)) + y * ln(m / (1/a + m))), 6) AS nb2_nll,
 round(-avg(y * ln(m) - m - lgamma(y + 1)), 6) AS poisson_nll FROM p JOIN f ON f.airport = p.airport GROUP BY ALL"""


def agg_40_interval_score(spark, folder):
    rows = _pred(spark, folder).withColumns({"low": F.greatest(F.lit(0.0), F.col("count_b") - 1.0), "high": F.col("count_b") + 1.0})
    return _r(rows.groupBy(*KEYS).agg(F.avg(st.interval_score(F.col("y"), F.col("low"), F.col("high"))).alias("interval_score")), 7, "interval_score")


QUERIES["agg_40_interval_score"] = agg_40_interval_score
ORACLE["agg_40_interval_score"] = f"""WITH {PRED}, p AS (SELECT *, greatest(0.0, count_b - 1) AS lo, count_b + 1 AS hi FROM pred)
SELECT airport, horizon, round(avg(hi - lo + CASE WHEN y < lo THEN 20 * (lo - y) ELSE 0 END + CASE WHEN y > hi THEN 20 * (y - hi) ELSE 0 END), 7) AS interval_score FROM p GROUP BY ALL"""


def agg_41_distribution(spark, folder):
    return _r(ev.distribution_summary(_pred(spark, folder), KEYS, "y"), 8, "mean", "variance", "variance_to_mean_ratio", "zero_fraction")


QUERIES["agg_41_distribution"] = agg_41_distribution
ORACLE["agg_41_distribution"] = f"""WITH {PRED} SELECT airport, horizon, count(*) AS scene_count, round(avg(y), 8) AS mean, round(var_pop(y), 8) AS variance, round(var_pop(y) / nullif(avg(y), 0), 8) AS variance_to_mean_ratio,
 round(avg(CAST(y = 0 AS INT)), 8) AS zero_fraction FROM pred GROUP BY ALL"""


def _indicator_records(spark, folder):
    ticks = stage_table(tk.carry_forward(event_reports(spark, folder), CFG), "ticks")
    indicators = ft.task_indicators(ft.scene_aircraft(ticks, CFG), CFG)
    labels = tg.scene_targets(ticks, CFG, separations=False).filter("horizon_s = 120").select(*tk.TICK, "onset_events")
    joined = indicators.join(labels, tk.TICK).withColumn("heading_dispersion", F.round("heading_dispersion", 9))
    return stage_table(joined, "indicators")


_METRICS = ["closing_pair_count_10nm", "screening_pair_count", "maneuvering_aircraft_count", "heading_dispersion"]


def _relationships(spark, folder):
    records = _indicator_records(spark, folder).select(
        "source_day", "current_aircraft_count", F.col("onset_events").cast("double").alias("target"), *[F.col(m).cast("double").alias(m) for m in _METRICS])
    return records.unpivot(["source_day", "current_aircraft_count", "target"], _METRICS, "metric", "value")


def agg_42_indicator_relationships(spark, folder):
    long = _relationships(spark, folder)
    block = (F.floor(F.col("value") * 16), F.floor(F.col("target") / 16))
    overall = ev.spearman(long, ["metric"], "value", "target", *block).withColumnRenamed("rho", "scene_spearman")
    daily = ev.spearman(long, ["metric", "source_day"], "value", "target", *block).filter("rho IS NOT NULL").groupBy("metric").agg(
        F.percentile("rho", 0.5).alias("daily_median"), F.percentile("rho", 0.25).alias("daily_q25"), F.percentile("rho", 0.75).alias("daily_q75"),
        F.count_if(F.col("rho") > 0).alias("positive_days"), F.count(F.lit(1)).alias("evaluable_days"))
    residual = ev.stratified_residual_correlation(long, ["metric"], ["source_day", "current_aircraft_count"], F.log1p("value"), F.log1p("target"))
    nonzero = long.groupBy("metric").agg(F.count_if(F.col("value") > 0).alias("nonzero_scenes"))
    joined = reduce(lambda a, b: a.join(b, "metric", "left"), [nonzero, overall, daily, residual])
    return _r(joined, 4, "scene_spearman", "daily_median", "daily_q25", "daily_q75", "residual_correlation")


QUERIES["agg_42_indicator_relationships"] = agg_42_indicator_relationships
_TAIL = S.TARGETS[len(S.PAIRS) + len(S.SCENES):]
_PAIRDEF = S.PAIRS[len(S.TICKS):]
RECORDS = INDICATORS + _PAIRDEF + _TAIL + """, rec AS (SELECT i.* REPLACE (round(i.heading_dispersion, 9) AS heading_dispersion), t.onset_events FROM indicators i JOIN targets t ON t.source_day = i.source_day AND t.k = i.k AND t.horizon_s = 120)"""
_LONG = RECORDS + ", long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, source_day, current_aircraft_count, CAST({m} AS DOUBLE) AS v, CAST(onset_events AS DOUBLE) AS t FROM rec" for m in _METRICS) + ")"
ORACLE["agg_42_indicator_relationships"] = f"""WITH {_LONG}, rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY metric ORDER BY t) + (count(*) OVER (PARTITION BY metric, t) - 1) / 2.0 AS b,
  rank() OVER (PARTITION BY metric, source_day ORDER BY v) + (count(*) OVER (PARTITION BY metric, source_day, v) - 1) / 2.0 AS da, rank() OVER (PARTITION BY metric, source_day ORDER BY t) + (count(*) OVER (PARTITION BY metric, source_day, t) - 1) / 2.0 AS db,
  ln(1 + v) - avg(ln(1 + v)) OVER (PARTITION BY metric, source_day, current_aircraft_count) AS ra, ln(1 + t) - avg(ln(1 + t)) OVER (PARTITION BY metric, source_day, current_aircraft_count) AS rb FROM long),
 dy AS (SELECT metric, source_day, corr(da, db) AS rho FROM rk GROUP BY ALL HAVING count(*) > 1 AND var_pop(da) > 0 AND var_pop(db) > 0),
 ds AS (SELECT metric, quantile_cont(rho, 0.5) AS q2, quantile_cont(rho, 0.25) AS q1, quantile_cont(rho, 0.75) AS q3, count(*) FILTER (WHERE rho > 0) AS pd, count(*) AS ed FROM dy GROUP BY metric)
SELECT rk.metric, count(*) FILTER (WHERE v > 0) AS nonzero_scenes, round(corr(a, b), 4) AS scene_spearman, round(any_value(q2), 4) AS daily_median, round(any_value(q1), 4) AS daily_q25, round(any_value(q3), 4) AS daily_q75,
 any_value(pd) AS positive_days, any_value(ed) AS evaluable_days, round(CASE WHEN sqrt(var_pop(ra) * var_pop(rb)) > 1e-12 THEN corr(ra, rb) END, 4) AS residual_correlation FROM rk LEFT JOIN ds ON ds.metric = rk.metric GROUP BY rk.metric"""


def win_11_average_ranks(spark, folder):
    rows = load(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").alias("v"))
    return ev.average_ranks(rows, ["l_returnflag"], "v", F.floor(F.col("v") / 8), "avg_rank")


QUERIES["win_11_average_ranks"] = win_11_average_ranks
ORACLE["win_11_average_ranks"] = """SELECT DISTINCT l_returnflag, l_quantity AS v, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS DOUBLE) AS avg_rank FROM lineitem"""


def agg_43_higher_quantiles(spark, folder):
    q = ev.higher_quantiles(_pred(spark, folder), KEYS, "y", {"q50": 0.5, "q70": 0.7, "q75": 0.75, "q90": 0.9})
    return q.withColumn("threshold", F.greatest(F.lit(1).cast("long"), F.col("q75")))


QUERIES["agg_43_higher_quantiles"] = agg_43_higher_quantiles
ORACLE["agg_43_higher_quantiles"] = f"""WITH {PRED}, l AS (SELECT airport, horizon, list(y ORDER BY y) AS v FROM pred GROUP BY ALL)
SELECT airport, horizon, {', '.join(f'v[CAST(ceil((len(v) - 1) * CAST({q} AS DOUBLE)) AS INT) + 1] AS {n}' for n, q in (('q50', 0.5), ('q70', 0.7), ('q75', 0.75), ('q90', 0.9)))},
 greatest(1, v[CAST(ceil((len(v) - 1) * 0.75) AS INT) + 1]) AS threshold FROM l"""


def agg_44_freshness_strata(spark, folder):
    rows = _pred(spark, folder).withColumn("stratum", F.when(F.col("max_report_age_s") <= 10, "fresh").otherwise("older"))
    keys = KEYS + ["stratum"]
    parts = [ev.score(rows, keys, "grp", p, t, pr).withColumn("measure", F.lit(p)) for p, t, pr in (("count_b", "y", False), ("count_a", "y", False), ("prob_b", "risk", True))]
    return _r(reduce(lambda a, b: a.unionByName(b), parts), 8, "equal_group_mean")


QUERIES["agg_44_freshness_strata"] = agg_44_freshness_strata
ORACLE["agg_44_freshness_strata"] = f"""WITH {PRED}, e AS (SELECT airport, horizon, CASE WHEN max_report_age_s <= 10 THEN 'fresh' ELSE 'older' END AS stratum, grp, risk, unnest(['count_b', 'count_a', 'prob_b']) AS measure,
  unnest([abs(count_b - y), abs(count_a - y), pow(prob_b - risk, 2)]) AS e FROM pred), g AS (SELECT airport, horizon, stratum, measure, grp, avg(e) AS e, count(*) AS n, sum(risk) AS r FROM e GROUP BY ALL)
SELECT airport, horizon, stratum, measure, round(avg(e), 8) AS equal_group_mean, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_scenes, CAST(sum(r) AS BIGINT) AS n_positive FROM g GROUP BY ALL"""


def agg_46_method_summary(spark, folder):
    runs = _pred(spark, folder).groupBy("airport", "grp").agg(F.avg("count_a").alias("validation_rmse"), F.avg("count_b").alias("test_rmse"))
    return _r(ev.method_summary(runs, "airport", ["validation_rmse", "test_rmse"]), 8, "validation_rmse_mean", "validation_rmse_sd", "test_rmse_mean", "test_rmse_sd")


QUERIES["agg_46_method_summary"] = agg_46_method_summary
ORACLE["agg_46_method_summary"] = f"""WITH {PRED}, g AS (SELECT airport, grp, avg(count_a) AS v, avg(count_b) AS t FROM pred GROUP BY ALL) SELECT airport, count(*) AS runs, round(avg(v), 8) AS validation_rmse_mean, round(coalesce(stddev_samp(v), 0), 8) AS validation_rmse_sd,
 round(avg(t), 8) AS test_rmse_mean, round(coalesce(stddev_samp(t), 0), 8) AS test_rmse_sd FROM g GROUP BY airport"""


def agg_47_latency(spark, folder):
    ms = load(spark, folder, "lineitem").select("l_linestatus", (F.col("l_partkey") * 137 / F.lit(1e6)).alias("ms"))
    totals = ms.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("iterations"), F.max("ms").alias("max_ms"))
    points = exact_quantiles(ms, ["l_linestatus"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95}, F.floor(F.col("ms") * 100))
    return _r(totals.join(points, "l_linestatus"), 8, "p50_ms", "p95_ms", "max_ms")


QUERIES["agg_47_latency"] = agg_47_latency
ORACLE["agg_47_latency"] = """SELECT l_linestatus, count(*) AS iterations, round(quantile_cont(l_partkey * 137 / 1e6, 0.5), 8) AS p50_ms, round(quantile_cont(l_partkey * 137 / 1e6, 0.95), 8) AS p95_ms, round(max(l_partkey * 137 / 1e6), 8) AS max_ms FROM lineitem GROUP BY 1"""


def agg_48_normalize(spark, folder):
    rows = event_reports(spark, folder).withColumn("flat", F.lit(3.0)).select("event_id", "source_day", "altitude_m", "speed_mps", "flat")
    return _r(ev.normalize(rows, ["altitude_m", "speed_mps", "flat"], F.col("source_day") < "2024-01-19").drop("source_day"), 6, "altitude_m", "speed_mps", "flat")


QUERIES["agg_48_normalize"] = agg_48_normalize
ORACLE["agg_48_normalize"] = f"""WITH {S.REPORTS}, s AS (SELECT avg(altitude_m) AS am, stddev_pop(altitude_m) AS asd, avg(speed_mps) AS sm, stddev_pop(speed_mps) AS ssd FROM reports WHERE source_day < '2024-01-19')
SELECT event_id, round((altitude_m - am) / asd, 6) AS altitude_m, round((speed_mps - sm) / ssd, 6) AS speed_mps, CAST(0 AS DOUBLE) AS flat FROM reports CROSS JOIN s"""


def agg_51_capacity(spark, folder):
    files = file_manifest(spark, folder)
    measured = files.filter("audit_type = 'csv'").groupBy(F.col("airport_id").alias("airport")).agg(
        F.count(F.lit(1)).alias("sample_rows"), (F.count(F.lit(1)) * 1000 + 7).alias("population_rows"), F.sum("size_bytes").alias("direct_bytes"))
    shared = files.filter("audit_type = 'binary'").agg(F.sum("size_bytes").alias("shared"))
    return ev.project_capacity(measured, shared, 10**9, 2 * 10**9, 8 * 10**9, 10**13, 10 * 1024**3)


QUERIES["agg_51_capacity"] = agg_51_capacity
ORACLE["agg_51_capacity"] = f"""WITH {MANIFEST}, m AS (SELECT airport_id AS airport, count(*) AS sr, count(*) * 1000 + 7 AS pr, CAST(sum(size_bytes) AS HUGEINT) AS d FROM manifest WHERE audit_type = 'csv' GROUP BY 1), h AS (SELECT CAST(sum(size_bytes) AS HUGEINT) AS sh FROM manifest WHERE audit_type = 'binary'),
 x AS (SELECT *, sum(sr) OVER () AS tot FROM m CROSS JOIN h), y AS (SELECT *, sh * sr // tot AS fl, row_number() OVER (ORDER BY sh * sr % tot DESC, airport) AS r FROM x), z AS (SELECT *, d + fl + CASE WHEN r <= sh - sum(fl) OVER () THEN 1 ELSE 0 END AS sb FROM y),
 f AS (SELECT sum(sb) AS sb, sum(sb * pr // sr) + CAST(ceil(round(sum((sb * pr % sr) / sr), 9)) AS HUGEINT) AS fin FROM z), p AS (SELECT *, (fin * (greatest(1000000000, sb) + sb) + sb - 1) // sb AS peak FROM f)
SELECT CAST(sb AS BIGINT) AS sample_bytes, CAST(fin AS BIGINT) AS finalized_bytes, CAST(peak AS BIGINT) AS peak_bytes, CAST((peak * 3 + 1) // 2 + 10737418240 AS BIGINT) AS required_bytes, 10000000000000 >= (peak * 3 + 1) // 2 + 10737418240 AS disk_ok, true AS memory_ok FROM p"""


def agg_52_enumeration(spark, folder):
    """Per source: rows, first and last row. Sources without rows keep empty bounds."""
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("source"))
    rows = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("source"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("p"))
    bounds = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("a"), F.max("p").alias("b"))
    return orders.join(bounds, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.col("a.l_partkey").alias("first_part"), F.col("b.l_partkey").alias("last_part"))


QUERIES["agg_52_enumeration"] = agg_52_enumeration
ORACLE["agg_52_enumeration"] = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS b FROM lineitem)
SELECT o_orderkey AS source, count(l_orderkey) AS n, max(l_partkey) FILTER (WHERE a = 1) AS first_part, max(l_partkey) FILTER (WHERE b = 1) AS last_part FROM orders LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY o_orderkey"""


def agg_53_seed_summary(spark, folder):
    runs = _pred(spark, folder).groupBy("airport", "horizon", (F.col("cutoff_us") / F.lit(86_400_000_000) % 3).cast("long").alias("seed")).agg(
        F.avg("count_a").alias("mae"), F.when(F.max("n_aircraft") > 8, F.avg("prob_b")).alias("r2"))
    return _r(ev.seed_summary(runs, KEYS, ["mae", "r2"]), 8, "mean", "least", "greatest")


QUERIES["agg_53_seed_summary"] = agg_53_seed_summary
ORACLE["agg_53_seed_summary"] = f"""WITH {PRED}, g AS (SELECT airport, horizon, cutoff_us // 86400000000 % 3 AS seed, avg(count_a) AS mae, CASE WHEN max(n_aircraft) > 8 THEN avg(prob_b) END AS r2 FROM pred GROUP BY ALL),
 l AS (SELECT airport, horizon, 'mae' AS metric, mae AS v FROM g UNION ALL SELECT airport, horizon, 'r2', r2 FROM g) SELECT airport, horizon, metric, round(avg(v), 8) AS mean, round(min(v), 8) AS least, round(max(v), 8) AS greatest FROM l GROUP BY ALL"""


def win_12_local_baseline(spark, folder):
    return _r(ev.local_baselines(_pred(spark, folder), KEYS, "grp"), 8, "local_pair_rate", "local_mean_count", "local_prevalence")


QUERIES["win_12_local_baseline"] = win_12_local_baseline
ORACLE["win_12_local_baseline"] = f"""WITH {PRED}, g AS (SELECT airport, horizon, grp, min(cutoff_us) AS s, max(cutoff_us + horizon * 1000000) AS e FROM pred GROUP BY ALL),
 x AS (SELECT g.airport, g.horizon, g.grp, h.grp AS pg, h.e FROM g JOIN g h ON h.airport = g.airport AND h.horizon = g.horizon AND h.e < g.s)
SELECT x.airport, x.horizon, x.grp, count(DISTINCT x.pg) AS calibration_groups, max(x.e) AS latest_label_us, round(sum(y) / sum(pair_opportunity), 8) AS local_pair_rate, round(avg(y), 8) AS local_mean_count, CAST(median(y) AS DOUBLE) AS local_median_count, round(avg(risk), 8) AS local_prevalence
FROM x JOIN pred p ON p.airport = x.airport AND p.horizon = x.horizon AND p.grp = x.pg GROUP BY ALL"""


def flt_05_matured_groups(spark, folder):
    base = ev.local_baselines(_pred(spark, folder), KEYS, "grp")
    return base.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("usable_groups"), F.min("grp").alias("first_group"), F.max("calibration_groups").alias("most_calibration_groups"))


QUERIES["flt_05_matured_groups"] = flt_05_matured_groups
ORACLE["flt_05_matured_groups"] = f"""WITH {PRED}, g AS (SELECT airport, horizon, grp, min(cutoff_us) AS s, max(cutoff_us + horizon * 1000000) AS e FROM pred GROUP BY ALL),
 x AS (SELECT g.airport, g.horizon, g.grp, count(*) AS n FROM g JOIN g h ON h.airport = g.airport AND h.horizon = g.horizon AND h.e < g.s GROUP BY ALL)
SELECT airport, horizon, count(*) AS usable_groups, min(grp) AS first_group, max(n) AS most_calibration_groups FROM x GROUP BY ALL"""


def _tests(spark, folder):
    losses = ev.group_losses(_pred(spark, folder).withColumn("early", F.col("grp") < "1998-06"), KEYS + ["early"], "grp", "y", "count_b", "count_a", "mae")
    shifted = losses.withColumn("delta", F.col("delta") + F.col("horizon") / 200.0)
    return ev.equal_group_comparison(shifted, KEYS + ["early"], 1e-9).withColumn("test", F.concat_ws("|", "airport", F.col("horizon").cast("string"), F.col("early").cast("string")))


def win_13_holm(spark, folder):
    adjusted = ev.holm(_tests(spark, folder).withColumn("sign_p", F.round("sign_p", 10)), ["airport"], "sign_p", "test")
    return _r(adjusted.select("test", "airport", "sign_p", "adjusted_p"), 8, "sign_p", "adjusted_p")


QUERIES["win_13_holm"] = win_13_holm
ORACLE["win_13_holm"] = f"""WITH {PRED}, gl0 AS (SELECT airport, horizon, grp < '1998-06' AS early, grp, avg(abs(count_b - y)) - avg(abs(count_a - y)) + max(horizon) / 200.0 AS c, 0 AS r FROM pred GROUP BY airport, horizon, grp < '1998-06', grp),
 t AS (SELECT airport, concat_ws('|', airport, horizon, early) AS test, {_WL} FROM gl0 GROUP BY airport, horizon, early), p AS (SELECT airport, test, round({_SIGN}, 10) AS p FROM t),
 o AS (SELECT *, row_number() OVER (PARTITION BY airport ORDER BY p, test) - 1 AS i, count(*) OVER (PARTITION BY airport) AS n FROM p)
SELECT test, airport, round(p, 8) AS sign_p, round(max(least(1.0, (n - i) * p)) OVER (PARTITION BY airport ORDER BY p, test ROWS UNBOUNDED PRECEDING), 8) AS adjusted_p FROM o"""


def ml_08_sign_test(spark, folder):
    return _r(_tests(spark, folder).select("test", "candidate_wins", "reference_wins", "ties", "sign_p"), 8, "sign_p")


QUERIES["ml_08_sign_test"] = ml_08_sign_test
ORACLE["ml_08_sign_test"] = f"""WITH {PRED}, gl0 AS (SELECT airport, horizon, grp < '1998-06' AS early, grp, avg(abs(count_b - y)) - avg(abs(count_a - y)) + max(horizon) / 200.0 AS c, 0 AS r FROM pred GROUP BY airport, horizon, grp < '1998-06', grp),
 t AS (SELECT concat_ws('|', airport, horizon, early) AS test, {_WL}, count(*) FILTER (WHERE abs(c) <= 1e-9) AS ties FROM gl0 GROUP BY airport, horizon, early) SELECT test, w AS candidate_wins, l AS reference_wins, ties, round({_SIGN}, 8) AS sign_p FROM t"""


def ml_07_monte_carlo(spark, folder):
    return _r(ev.monte_carlo_interval(_losses(spark, folder), KEYS, "grp", "delta", 10_000, "seed-1701"), 7, "mean", "lower", "upper")


QUERIES["ml_07_monte_carlo"] = ml_07_monte_carlo
ORACLE["ml_07_monte_carlo"] = f"""WITH {_GL}, d AS (SELECT airport, horizon, c - r AS v, row_number() OVER (PARTITION BY airport, horizon ORDER BY grp) - 1 AS i FROM gl), n AS (SELECT airport, horizon, count(*) AS n, avg(v) AS mean FROM d GROUP BY ALL),
 dr AS (SELECT *, unnest(range(0, n)) AS j FROM (SELECT *, unnest(range(0, 10000)) AS r FROM n)),
 m AS (SELECT dr.airport, dr.horizon, dr.r, any_value(n) AS n, any_value(mean) AS mean, avg(v) AS m FROM dr JOIN d ON d.airport = dr.airport AND d.horizon = dr.horizon AND d.i = CAST(('0x' || substr(sha256(concat_ws('|', 'seed-1701', dr.r, dr.j)), 1, 12)) AS BIGINT) % n GROUP BY ALL)
SELECT airport, horizon, any_value(n) AS group_count, round(any_value(mean), 7) AS mean, round(quantile_cont(m, 0.025), 7) AS lower, round(quantile_cont(m, 0.975), 7) AS upper, count(*) AS resample_count FROM m GROUP BY ALL"""


def ml_07_exhaustive(spark, folder):
    rows = _pred(spark, folder).withColumn("year", F.substring("grp", 1, 4))
    losses = ev.group_losses(rows, [], "year", "y", "count_b", "count_a", "mae")
    return _r(ev.exhaustive_interval(losses, "year", "delta"), 7, "mean", "lower", "upper")


QUERIES["ml_07_exhaustive"] = ml_07_exhaustive
ORACLE["ml_07_exhaustive"] = f"""WITH {PRED}, d AS (SELECT substr(grp, 1, 4) AS year, avg(abs(count_b - y)) - avg(abs(count_a - y)) AS v FROM pred GROUP BY 1),
 m AS (SELECT (a.v + b.v + c.v + e.v + f.v + g.v + h.v) / 7 AS m FROM d a, d b, d c, d e, d f, d g, d h) SELECT (SELECT round(avg(v), 7) FROM d) AS mean, round(quantile_cont(m, 0.025), 7) AS lower, round(quantile_cont(m, 0.975), 7) AS upper, count(*) AS resample_count FROM m"""


def ml_09_gates(spark, folder):
    """Six conditions per horizon and the overall decision: at least two horizons must pass."""
    rows = _pred(spark, folder)
    b = ev.equal_group_comparison(ev.group_losses(rows, ["horizon"], "grp", "y", "count_b", "count_a", "mae"), ["horizon"], 1e-9)
    p = ev.equal_group_comparison(ev.group_losses(rows.withColumn("half", F.lit(0.5)), ["horizon"], "grp", "risk", "prob_b", "half", "brier"), ["horizon"], 1e-9)
    cond = lambda df, n: df.select("horizon", ((F.col("candidate_minus_reference") < 0) & (F.col("candidate_wins") >= F.floor(F.col("group_count") / 2) + 1)).alias(n))
    both = cond(b, "count_pass").join(cond(p, "risk_pass"), "horizon").withColumn("horizon_pass", F.col("count_pass") & F.col("risk_pass"))
    return ev.one_row_join(both, both.agg((F.count_if("horizon_pass") >= 2).alias("route_pass")))


QUERIES["ml_09_gates"] = ml_09_gates
ORACLE["ml_09_gates"] = f"""WITH {PRED}, g AS (SELECT horizon, grp, avg(abs(count_b - y)) - avg(abs(count_a - y)) AS d, avg(pow(prob_b - risk, 2)) - avg(pow(0.5 - risk, 2)) AS e FROM pred GROUP BY ALL),
 c AS (SELECT horizon, avg(d) < 0 AND count(*) FILTER (WHERE d < -1e-9) >= count(*) // 2 + 1 AS count_pass, avg(e) < 0 AND count(*) FILTER (WHERE e < -1e-9) >= count(*) // 2 + 1 AS risk_pass FROM g GROUP BY horizon)
SELECT horizon, count_pass, risk_pass, count_pass AND risk_pass AS horizon_pass, (SELECT count(*) FILTER (WHERE count_pass AND risk_pass) >= 2 FROM c) AS route_pass FROM c"""

_Q = {"traffic": ("current_aircraft_count", 0.75), "closing": ("closing_pair_count_10nm", 0.75), "projected": ("projected_separation_task_count_120s", 0.75), "traffic50": ("current_aircraft_count", 0.5)}


def _regime(spark, folder):
    """Thresholds come from the training days and travel with the rows as columns."""
    records = _indicator_records(spark, folder)
    train = records.filter("source_day < '2024-01-19'")
    for name, (indicator, q) in _Q.items():
        records = ev.one_row_join(records, ev.higher_quantiles(train, [], indicator, {f"th_{name}": q}))
    t = {n: F.col(f"th_{n}") for n in _Q}
    rules = {
        "traffic_q75": ev.apply_rule([("current_aircraft_count", t["traffic"], 0)]), "closing_q75": ev.apply_rule([("closing_pair_count_10nm", t["closing"], 0)]),
        "projected_q75": ev.apply_rule([("projected_separation_task_count_120s", t["projected"], 0)]),
        "balanced_interaction": ev.apply_rule([("current_aircraft_count", t["traffic50"], 0), ("closing_pair_count_10nm", t["closing"], 1), ("projected_separation_task_count_120s", t["projected"], 1)]),
    }
    return records, rules


def flt_03_regime_rules(spark, folder):
    records, rules = _regime(spark, folder)
    return records.select(*tk.TICK, *[r.alias(n) for n, r in rules.items()])


QUERIES["flt_03_regime_rules"] = flt_03_regime_rules
_HQ = ", ".join(f"(SELECT (list({i} ORDER BY {i}))[CAST(ceil((count(*) - 1) * {q}) AS INT) + 1] FROM rec WHERE source_day < '2024-01-19') AS th_{n}" for n, (i, q) in _Q.items())
_RULES = RECORDS + f""", th AS (SELECT {_HQ}), ruled AS (SELECT rec.*, current_aircraft_count >= th_traffic AS traffic_q75, closing_pair_count_10nm >= th_closing AS closing_q75, projected_separation_task_count_120s >= th_projected AS projected_q75,
  current_aircraft_count >= th_traffic50 AND (closing_pair_count_10nm >= th_closing OR projected_separation_task_count_120s >= th_projected) AS balanced_interaction FROM rec CROSS JOIN th)"""
ORACLE["flt_03_regime_rules"] = f"WITH {_RULES} SELECT airport_id, source_day, k, traffic_q75, closing_q75, projected_q75, balanced_interaction FROM ruled"


def ml_10_rule_selection(spark, folder):
    records, rules = _regime(spark, folder)
    y = F.col("onset_events")
    chosen = ev.select_rule(records.filter("source_day >= '2024-01-19'"), rules, "source_day", F.abs(F.col("projected_separation_task_count_120s") - y), F.abs(F.col("closing_pair_count_10nm") - y), min_day=5)
    return _r(chosen, 8, "coverage", "equal_day_delta")


QUERIES["ml_10_rule_selection"] = ml_10_rule_selection
_RN = ["traffic_q75", "closing_q75", "projected_q75", "balanced_interaction"]
ORACLE["ml_10_rule_selection"] = f"""WITH {_RULES}, l AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule_id, source_day, {r} AS hit, abs(projected_separation_task_count_120s - onset_events) - abs(closing_pair_count_10nm - onset_events) AS d FROM ruled WHERE source_day >= '2024-01-19'" for r in _RN)}),
 g AS (SELECT rule_id, source_day, count(*) AS n, count(*) FILTER (WHERE hit) AS h, avg(d) FILTER (WHERE hit) AS d FROM l GROUP BY ALL), s AS (SELECT rule_id, CAST(sum(h) AS BIGINT) AS scene_count, sum(h) / sum(n) AS cov, min(h) AS least_day, avg(d) AS dl FROM g GROUP BY ALL),
 e AS (SELECT *, cov BETWEEN 0.1 AND 0.6 AND least_day >= 5 AS ok FROM s)
SELECT rule_id, scene_count, round(cov, 8) AS coverage, least_day, round(dl, 8) AS equal_day_delta, ok AS eligible, ok AND rule_id = (SELECT arg_min(rule_id, dl) FROM e WHERE ok) AS selected FROM e"""


def ml_11_regime_metrics(spark, folder):
    records, rules = _regime(spark, folder)
    y = F.col("onset_events")
    rows = records.withColumn("regime", F.when(rules["balanced_interaction"], "high").otherwise("low")).withColumn("day", F.col("source_day"))
    per = rows.groupBy("regime", "day").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("projected_separation_task_count_120s") - y)).alias("a"), F.avg(F.abs(F.col("closing_pair_count_10nm") - y)).alias("b"))
    usable = per.filter("n >= 5")
    out = usable.groupBy("regime").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("scenes"), F.avg("a").alias("candidate_mae"), F.avg("b").alias("reference_mae"),
        F.count_if(F.col("a") < F.col("b") - 1e-9).alias("wins"), F.count_if(F.col("a") > F.col("b") + 1e-9).alias("losses"))
    return _r(out, 8, "candidate_mae", "reference_mae")


QUERIES["ml_11_regime_metrics"] = ml_11_regime_metrics
ORACLE["ml_11_regime_metrics"] = f"""WITH {_RULES}, g AS (SELECT CASE WHEN balanced_interaction THEN 'high' ELSE 'low' END AS regime, source_day, count(*) AS n, avg(abs(projected_separation_task_count_120s - onset_events)) AS a, avg(abs(closing_pair_count_10nm - onset_events)) AS b FROM ruled GROUP BY ALL HAVING count(*) >= 5)
SELECT regime, count(*) AS days, CAST(sum(n) AS BIGINT) AS scenes, round(avg(a), 8) AS candidate_mae, round(avg(b), 8) AS reference_mae, count(*) FILTER (WHERE a < b - 1e-9) AS wins, count(*) FILTER (WHERE a > b + 1e-9) AS losses FROM g GROUP BY regime"""


def ml_13_regression_metrics(spark, folder):
    rows = _pred(spark, folder)
    e = F.col("count_b") - F.col("y")
    m = rows.groupBy(*KEYS).agg((F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"), F.avg(F.abs(e)).alias("mae"))
    rho = ev.spearman(rows, KEYS, "count_b", "y", F.floor(F.col("count_b")), F.floor(F.col("y") / 4))
    return _r(m.join(rho, KEYS), 6, "r2", "mae", "rho")


QUERIES["ml_13_regression_metrics"] = ml_13_regression_metrics
ORACLE["ml_13_regression_metrics"] = f"""WITH {PRED}, rk AS (SELECT *, rank() OVER (PARTITION BY airport, horizon ORDER BY count_b) + (count(*) OVER (PARTITION BY airport, horizon, count_b) - 1) / 2.0 AS a, rank() OVER (PARTITION BY airport, horizon ORDER BY y) + (count(*) OVER (PARTITION BY airport, horizon, y) - 1) / 2.0 AS b FROM pred)
SELECT airport, horizon, round(1 - avg(pow(count_b - y, 2)) / var_pop(y), 6) AS r2, round(avg(abs(count_b - y)), 6) AS mae, round(corr(a, b), 6) AS rho FROM rk GROUP BY ALL"""


def fn_08_transforms(spark, folder):
    p = _pred(spark, folder)
    return _r(p.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log1p("y")).alias("logged"), F.avg(F.greatest(F.expm1(F.log1p("y") - 0.1), F.lit(0.0))).alias("back"), F.max(F.hypot("y", "count_a")).alias("length")), 8, "logged", "back", "length")


QUERIES["fn_08_transforms"] = fn_08_transforms
ORACLE["fn_08_transforms"] = f"WITH {PRED} SELECT y, count(*) AS n, round(avg(ln(1 + y)), 8) AS logged, round(avg(greatest(exp(ln(1 + y) - 0.1) - 1, 0)), 8) AS back, round(max(sqrt(y * y + count_a * count_a)), 8) AS length FROM pred GROUP BY y"


def fn_13_count_tails(spark, folder):
    p = _pred(spark, folder).select("count_a").groupBy("count_a").agg(F.count(F.lit(1)).alias("n"))
    d = F.lit(0.35)
    return _r(p.select("count_a", "n", st.nb2_tail(F.col("count_a"), d, 1).alias("tail_1"), st.nb2_tail(F.col("count_a"), d, 3).alias("tail_3"), st.nb2_tail(F.col("count_a"), F.lit(0.0), 2).alias("poisson_2")), 8, "tail_1", "tail_3", "poisson_2")


QUERIES["fn_13_count_tails"] = fn_13_count_tails
_PM = lambda k: f"exp(lgamma({k} + s) - lgamma(s) - lgamma({k} + 1) + s * ln(s / (s + m)) + {k} * ln(m / (s + m)))"
ORACLE["fn_13_count_tails"] = f"""WITH {PRED}, p AS (SELECT count_a, count(*) AS n, greatest(count_a, 1e-8) AS m, 1 / 0.35 AS s FROM pred GROUP BY count_a)
SELECT count_a, n, round(1 - {_PM(0)}, 8) + 0.0 AS tail_1, round(1 - {_PM(0)} - {_PM(1)} - {_PM(2)}, 8) + 0.0 AS tail_3, round(1 - exp(-m) * (1 + m), 8) + 0.0 AS poisson_2 FROM p"""
