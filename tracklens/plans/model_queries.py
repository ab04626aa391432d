"""Model-fit queries: scene features against future-onset counts, and scored line items."""

from pyspark.sql import functions as F

from tracklens import constants as K
from tracklens.config import EVENT_CONFIG as CFG
from tracklens.operators import features as ft, models as M, targets as tg, ticks as tk
from tracklens.session import stage_table
from tracklens.sources.tables import event_reports, prediction_rows

QUERIES: dict = {}
ORACLE: dict = {}


def _newton_sql(rows: str, gradient: tuple[str, str], hessian: tuple[str, str, str], start: str, steps: int = 14) -> str:
    """Common table expressions n0 .. n<steps>: Newton steps for the parameters a and b of each model.

    `rows` selects (model, x, y); `gradient` and `hessian` are sums that read p, the linear predictor a + b * x, and
    the two parameters. A model has two parameters, so a step is a 2 x 2 system.
    """
    ctes = [f"r AS ({rows})", f"n0 AS ({start})"]
    for k in range(steps):
        ctes.append(f"""n{k + 1} AS (SELECT model, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (
 SELECT model, any_value(a) AS a, any_value(b) AS b, {gradient[0]} AS g0, {gradient[1]} AS g1, {hessian[0]} AS h00, {hessian[1]} AS h01, {hessian[2]} AS h11
 FROM (SELECT r.*, n.a, n.b, n.a + n.b * r.x AS p FROM r JOIN n{k} n ON n.model = r.model) GROUP BY model))""")
    return ", ".join(ctes)


SCORED = """SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'AP2' ELSE 'AP1' END AS model, CAST(l_partkey % 70 AS DOUBLE) / CAST(10 AS DOUBLE) AS x0,
 CAST(l_quantity AS BIGINT) % 8 AS y, CASE WHEN CAST(l_quantity AS BIGINT) % 8 >= 3 THEN 1.0 ELSE 0.0 END AS risk,
 CAST((CAST(l_quantity AS BIGINT) % 8) * 100 + l_suppkey % 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob_b FROM lineitem"""
A = ["current_aircraft_count", "current_altitude_mean_m", "current_altitude_std_m", "current_speed_mean_mps", "current_low_altitude_fraction"]
B = A + ["current_active_pair_count_5nm_1000ft", "mean_pair_horizontal_distance_m", "minimum_pair_vertical_separation_m"]


def _scenes(spark, folder):
    ticks = stage_table(tk.carry_forward(tk.finite_reports(event_reports(spark, folder)), CFG), "ticks")
    ladder = ft.feature_ladder(ft.scene_aircraft(ticks, CFG), CFG, B)
    labels = tg.scene_targets(ticks, CFG, separations=False).filter("horizon_s = 120").select(*tk.TICK, "onset_events")
    rows = ladder.join(labels, tk.TICK).withColumn("risk", (F.col("onset_events") >= 20).cast("int"))
    return stage_table(rows.select("source_day", *[F.col(c).cast("double").alias(c) for c in B], "onset_events", "risk"), "scene-features")


def ml_01_ridge(spark, folder):
    rows = _scenes(spark, folder)
    return M.model_table(spark, {"A": M.fit_ridge_log1p(rows, A, "onset_events"), "B": M.fit_ridge_log1p(rows, B, "onset_events")})


QUERIES["ml_01_ridge"] = ml_01_ridge


def ml_01_ridge_single(spark, folder):
    """One-feature ridge per scored airport has a closed form that SQL can state."""
    rows = prediction_rows(spark, folder)
    return M.model_table(spark, {a: M.fit_ridge_log1p(rows.filter(F.col("airport") == a), ["count_a"], "y") for a in ("AP1", "AP2")}, 8)


QUERIES["ml_01_ridge_single"] = ml_01_ridge_single
ORACLE["ml_01_ridge_single"] = """WITH p AS (SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'AP2' ELSE 'AP1' END AS airport, CAST(l_partkey % 70 AS DOUBLE) / CAST(10 AS DOUBLE) AS x, ln(1 + CAST(l_quantity AS BIGINT) % 8) AS y FROM lineitem),
 m AS (SELECT airport, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) / (count(*) + 1.0) / var_pop(x) AS w FROM p GROUP BY airport)
SELECT airport AS model, 'intercept' AS term, round(my - w * mx, 8) AS weight FROM m UNION ALL SELECT airport, 'count_a', round(w, 8) FROM m"""


def ml_02_poisson(spark, folder):
    rows = _scenes(spark, folder)
    return M.model_table(spark, {"A": M.fit_poisson(rows, A, "onset_events"), "B": M.fit_poisson(rows, B, "onset_events")})


QUERIES["ml_02_poisson"] = ml_02_poisson


def ml_02_poisson_single(spark, folder):
    """One-feature Poisson regression per scored airport; SQL can state its Newton steps."""
    rows = prediction_rows(spark, folder)
    return M.model_table(spark, {a: M.fit_poisson(rows.filter(F.col("airport") == a), ["count_a"], "y") for a in ("AP1", "AP2")}, 6)


QUERIES["ml_02_poisson_single"] = ml_02_poisson_single
ORACLE["ml_02_poisson_single"] = f"""WITH {_newton_sql(
    f"SELECT model, x0 AS x, y FROM ({SCORED})", ("sum(exp(p) - y)", "sum((exp(p) - y) * x)"), ("sum(exp(p))", "sum(exp(p) * x)", "sum(exp(p) * x * x)"),
    "SELECT model, ln(avg(y)) AS a, CAST(0 AS DOUBLE) AS b FROM r GROUP BY model")}
SELECT model, 'intercept' AS term, round(a, 6) AS weight FROM n14 UNION ALL SELECT model, 'count_a', round(b, 6) FROM n14"""


def ml_03_logistic(spark, folder):
    return M.model_table(spark, {"B": M.fit_logistic(_scenes(spark, folder), B, "risk")})


QUERIES["ml_03_logistic"] = ml_03_logistic


def ml_03_logistic_single(spark, folder):
    """One-feature penalised logistic regression per scored airport; SQL can state its Newton steps."""
    rows = prediction_rows(spark, folder)
    return M.model_table(spark, {a: M.fit_logistic(rows.filter(F.col("airport") == a), ["count_a"], "risk") for a in ("AP1", "AP2")}, 5)


QUERIES["ml_03_logistic_single"] = ml_03_logistic_single
ORACLE["ml_03_logistic_single"] = f"""WITH m AS (SELECT model, avg(x0) AS mean, stddev_pop(x0) AS scale FROM ({SCORED}) GROUP BY model), {_newton_sql(
    f"SELECT s.model, (x0 - mean) / scale AS x, risk AS y FROM ({SCORED}) s JOIN m ON m.model = s.model",
    ("sum(1 / (1 + exp(-p)) - y)", "sum((1 / (1 + exp(-p)) - y) * x) + any_value(b)"),
    ("sum(exp(-p) / pow(1 + exp(-p), 2))", "sum(x * exp(-p) / pow(1 + exp(-p), 2))", "sum(x * x * exp(-p) / pow(1 + exp(-p), 2)) + 1"),
    "SELECT model, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM r GROUP BY model")}
SELECT n.model, 'intercept' AS term, round(a - b * mean / scale, 5) AS weight FROM n14 n JOIN m ON m.model = n.model
UNION ALL SELECT n.model, 'count_a', round(b / scale, 5) FROM n14 n JOIN m ON m.model = n.model"""


def ml_04_boosted_trees(spark, folder):
    rows = _scenes(spark, folder)
    model = M.fit_boosted_trees(rows, B, "onset_events", iterations=10)
    return spark.createDataFrame([(n, round(float(w), 6)) for n, w in zip(B, model.featureImportances.toArray())], "term string, importance double")


QUERIES["ml_04_boosted_trees"] = ml_04_boosted_trees


def ml_05_nb2(spark, folder):
    model, fit = M.fit_nb2(prediction_rows(spark, folder), ["count_a", "n_aircraft"], "y")
    return M.model_table(spark, {"nb2": model}, 4)


QUERIES["ml_05_nb2"] = ml_05_nb2


def ml_05_nb2_single(spark, folder):
    """One-feature negative-binomial fit per scored airport; SQL can state the scoring steps."""
    rows = prediction_rows(spark, folder)
    return M.model_table(spark, {a: M.fit_nb2(rows.filter(F.col("airport") == a), ["count_a"], "y")[0] for a in ("AP1", "AP2")}, 5)


def _nb2_sql(steps: int = 25) -> str:
    ctes = [f"r AS (SELECT model, x0 AS x, y FROM ({SCORED}))",
            "above AS (SELECT model, j, count(*) AS n FROM (SELECT model, unnest(range(0, y)) AS j FROM r) GROUP BY model, j)",
            "n0 AS (SELECT model, ln(avg(y)) AS a, CAST(0 AS DOUBLE) AS b, greatest((var_pop(y) - avg(y)) / pow(avg(y), 2), 0.001) AS al FROM r GROUP BY model)"]
    for k in range(steps):
        ctes.append(f"""s{k} AS (SELECT model, any_value(al) AS al, any_value(a) AS a, any_value(b) AS b, sum((mu - y) / (1 + al * mu)) AS g0, sum((mu - y) / (1 + al * mu) * x) AS g1,
  sum(mu / (1 + al * mu)) AS h00, sum(mu / (1 + al * mu) * x) AS h01, sum(mu / (1 + al * mu) * x * x) AS h11, sum(ln(1 + al * mu) / (al * al) - (y + 1 / al) * mu / (1 + al * mu)) AS d1,
  sum((y + 1 / al) * pow(mu / (1 + al * mu), 2) + 2 * mu / (al * al * (1 + al * mu)) - 2 * ln(1 + al * mu) / pow(al, 3)) AS d2
 FROM (SELECT r.*, n.a, n.b, n.al, exp(n.a + n.b * r.x) AS mu FROM r JOIN n{k} n ON n.model = r.model) GROUP BY model)""")
        ctes.append(f"t{k} AS (SELECT n.model, sum(v.n * v.j / (1 + al * v.j)) AS r1, -sum(v.n * pow(v.j / (1 + al * v.j), 2)) AS r2 FROM above v JOIN n{k} n ON n.model = v.model GROUP BY n.model)")
        ctes.append(f"""n{k + 1} AS (SELECT s.model, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b,
  al * exp(-(d1 + r1) / (al * (d2 + r2) + d1 + r1)) AS al FROM s{k} s JOIN t{k} t ON t.model = s.model)""")
    last = f"n{steps}"
    return f"""WITH {', '.join(ctes)} SELECT model, 'intercept' AS term, round(a, 5) AS weight FROM {last}
UNION ALL SELECT model, 'count_a', round(b, 5) FROM {last} UNION ALL SELECT model, 'dispersion', round(al, 5) FROM {last}"""


QUERIES["ml_05_nb2_single"] = ml_05_nb2_single
ORACLE["ml_05_nb2_single"] = _nb2_sql()


def ml_06_calibration(spark, folder):
    line = M.calibration_line(prediction_rows(spark, folder), "risk", "prob_b")
    return spark.createDataFrame([(round(line["intercept"], 6), round(line["slope"], 6), line["converged"])], "intercept double, slope double, converged boolean")


QUERIES["ml_06_calibration"] = ml_06_calibration


def ml_06_calibration_blend(spark, folder):
    """Calibration of a blend whose labels overlap; SQL can state the Newton steps."""
    rows = prediction_rows(spark, folder).withColumn("blend", (F.col("prob_b") + F.col("count_a") / F.lit(7.0)) / F.lit(2.0))
    line = M.calibration_line(rows, "risk", "blend")
    return spark.createDataFrame([(round(line["intercept"], 6), round(line["slope"], 6), line["converged"])], "intercept double, slope double, converged boolean")


QUERIES["ml_06_calibration_blend"] = ml_06_calibration_blend
ORACLE["ml_06_calibration_blend"] = f"""WITH {_newton_sql(
    f"SELECT 1 AS model, ln(q) - ln(1 - q) AS x, risk AS y FROM (SELECT risk, least(greatest((prob_b + x0 / CAST(7 AS DOUBLE)) / CAST(2 AS DOUBLE), {K.LOGIT_CLIP}), 1 - {K.LOGIT_CLIP}) AS q FROM ({SCORED}))",
    ("sum(1 / (1 + exp(-p)) - y)", "sum((1 / (1 + exp(-p)) - y) * x)"),
    ("sum(exp(-p) / pow(1 + exp(-p), 2))", "sum(x * exp(-p) / pow(1 + exp(-p), 2))", "sum(x * x * exp(-p) / pow(1 + exp(-p), 2))"),
    "SELECT 1 AS model, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b")}
SELECT round(n14.a, 6) AS intercept, round(n14.b, 6) AS slope, abs(n14.a - n13.a) < 1e-9 AND abs(n14.b - n13.b) < 1e-9 AS converged FROM n14, n13"""


def ml_15_site_ridge(spark, folder):
    rows, names = M.group_interactions(prediction_rows(spark, folder), ["count_a", "n_aircraft"], "airport", ["AP2"])
    return M.model_table(spark, {"site": M.fit_ridge_log1p(rows, names, "y")})


QUERIES["ml_15_site_ridge"] = ml_15_site_ridge


def ml_15_site_ridge_single(spark, folder):
    """One feature with its site effect: ridge of two standardised columns, which SQL can solve."""
    rows, names = M.group_interactions(prediction_rows(spark, folder), ["count_a"], "airport", ["AP2"])
    return M.model_table(spark, {"site": M.fit_ridge_log1p(rows, names, "y")}, 8)


QUERIES["ml_15_site_ridge_single"] = ml_15_site_ridge_single
ORACLE["ml_15_site_ridge_single"] = f"""WITH d AS (SELECT x0 AS u, CASE WHEN model = 'AP2' THEN x0 ELSE 0.0 END AS v, ln(1 + y) AS t FROM ({SCORED})),
 m AS (SELECT count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(t) AS mt, stddev_pop(u) AS su, stddev_pop(v) AS sv, covar_pop(u, v) / stddev_pop(u) / stddev_pop(v) AS uv,
  covar_pop(u, t) / stddev_pop(u) AS ut, covar_pop(v, t) / stddev_pop(v) AS vt FROM d),
 w AS (SELECT *, n * (ut * (n + 1.0) - n * uv * vt) / (pow(n + 1.0, 2) - pow(n * uv, 2)) / su AS wu, n * (vt * (n + 1.0) - n * uv * ut) / (pow(n + 1.0, 2) - pow(n * uv, 2)) / sv AS wv FROM m)
SELECT 'site' AS model, 'intercept' AS term, round(mt - wu * mu - wv * mv, 8) AS weight FROM w
UNION ALL SELECT 'site', 'count_a', round(wu, 8) FROM w UNION ALL SELECT 'site', 'count_a__AP2', round(wv, 8) FROM w"""
