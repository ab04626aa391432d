"""Metrics, intervals and tests with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.functions import stats as st
from tracklens.operators import evaluate as ev, models as M, selection as sel


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_higher_quantiles(spark):
    q = ev.higher_quantiles(frame(spark, "v long", [(v,) for v in (3, 4, 5, 6)]), [], "v", {"q75": 0.75, "q50": 0.5}).first()
    assert (q.q75, q.q50) == (6, 5)
    q = ev.higher_quantiles(frame(spark, "v long", [(v,) for v in (0, 0, 1, 2, 3, 5, 8, 13)]), [], "v", {"a": 0.7, "b": 0.75, "c": 0.8, "d": 0.9}).first()
    assert tuple(q) == (5, 8, 8, 13)


def test_calibration_error(spark):
    rows = frame(spark, "p double, y int", [(0.1, 0), (0.1, 0), (0.9, 1), (0.9, 1)])
    assert ev.calibration_error(rows, [], "y", "p").first().ece == pytest.approx(0.1)
    assert ev.reliability(frame(spark, "p double, y int, g string", [(1.0, 1, "a")]), [], "y", "p", "g").filter("n > 0").first().bin == 9


def test_interval_score(spark):
    df = frame(spark, "y double, lo double, hi double", [(2.0, 1.0, 3.0), (0.0, 1.0, 3.0)])
    assert [r[0] for r in df.select(st.interval_score(df.y, df.lo, df.hi)).collect()] == pytest.approx([2.0, 22.0])


def test_count_metrics(spark):
    m = ev.count_metrics(frame(spark, "y double, p double", [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)]), [], "y", "p").first()
    assert (m.count_mae, m.count_rmse) == (pytest.approx(2 / 3), pytest.approx(math.sqrt(2 / 3)))


def test_sign_test_and_holm(spark):
    df = frame(spark, "w long, l long", [(8, 0), (0, 0), (5, 5), (1500, 1500), (3, 1)])
    p = [r[0] for r in df.select(st.sign_test(df.w, df.l)).collect()]
    assert p == pytest.approx([0.0078125, 1.0, 1.0, 1.0, 0.625])
    tests = frame(spark, "f string, name string, p double", [("f", "a", 0.03), ("f", "b", 0.01), ("f", "c", 0.2)])
    assert {r.name: pytest.approx(r.adjusted_p) for r in ev.holm(tests, ["f"], "p", "name").collect()} == {"a": 0.06, "b": 0.03, "c": 0.2}


def test_exposure_rate(spark):
    fit = ev.exposure_rate(frame(spark, "y long, m long", [(0, 1), (2, 3)]), [], "y", "m").first().rate
    assert [fit * m for m in (0, 2, 4)] == [0, 1, 2]
    assert ev.exposure_rate(frame(spark, "y long, m long", [(1, 0), (2, 0)]), [], "y", "m").first().rate == 1.5


def test_group_comparison_weighs_groups(spark):
    rows = frame(spark, "g string, y double, a double, b double", [("x", 0.0, 0.0, 2.0)] * 3 + [("y", 0.0, 2.0, 0.0)])
    c = ev.equal_group_comparison(ev.group_losses(rows, [], "g", "y", "a", "b", "mae"), []).first()
    assert (c.candidate_equal_group_mean, c.reference_equal_group_mean, c.candidate_wins, c.reference_wins) == (1.0, 1.0, 1, 1)


def test_local_baselines(spark):
    s = 1_000_000
    rows = [("a", 0, 2, 1, 1), ("b", 100 * s, 0, 1, 0), ("c", 300 * s, 1, 1, 1)]
    df = frame(spark, "k string, grp string, cutoff_us long, y long, pair_opportunity long, risk long, horizon long", [("k", g, c, y, o, r, 30) for g, c, y, o, r in rows])
    got = {r.grp: r for r in ev.local_baselines(df, ["k"], "grp").collect()}
    assert set(got) == {"b", "c"}
    assert (got["b"].local_prevalence, got["b"].local_pair_rate) == (1.0, 2.0)
    assert (got["c"].local_prevalence, got["c"].local_pair_rate, got["c"].local_median_count) == (0.5, 1.0, 1.0)
    late = df.withColumn("horizon", F.lit(1000).cast("long"))
    assert ev.local_baselines(late, ["k"], "grp").count() == 0


def test_rank_correlation(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, 80), rng.normal(size=80)
    df = frame(spark, "k string, x double, y double, c double", [("k", float(a), float(b), 1.0) for a, b in zip(x, y)])

    def ranks(v):
        v = np.asarray(v)
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    rho = ev.spearman(df, ["k"], "x", "y", F.floor("x"), F.floor("y")).first().rho
    assert rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert ev.spearman(df, ["k"], "x", "c", F.floor("x"), F.floor("c")).first().rho is None


def test_nb2_matches_gamma_form(spark):
    rows = [(0, 0.5), (3, 2.0), (7, 4.5), (1, 1e-12)]
    df = frame(spark, "y long, m double", rows)
    alpha = 0.4
    got = [r[0] for r in df.select(st.nb2_nll(df.y, df.m, F.lit(alpha))).collect()]

    def nll(y, m):
        m, s = max(m, 1e-8), 1 / alpha
        p = s / (s + m)
        return -(math.lgamma(y + s) - math.lgamma(s) - math.lgamma(y + 1) + s * math.log(p) + y * math.log1p(-p))

    assert got == pytest.approx([nll(y, m) for y, m in rows])
    pmf = lambda k, m: math.exp(-nll(k, m))
    tail = df.select(st.nb2_tail(df.m, F.lit(alpha), 3)).first()[0]
    assert tail == pytest.approx(1 - sum(pmf(k, 0.5) for k in range(3)))


def test_exhaustive_bootstrap(spark):
    df = frame(spark, "g string, v double", [("a", -1.0), ("b", 0.0), ("c", 2.0)])
    r = ev.exhaustive_interval(df, "g", "v").first()
    means = np.array([np.mean([p, q, s]) for p in (-1, 0, 2) for q in (-1, 0, 2) for s in (-1, 0, 2)])
    assert r.resample_count == 27 and (r.lower, r.upper) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    with pytest.raises(ValueError):
        ev.exhaustive_interval(frame(spark, "g int, v double", [(i, 1.0) for i in range(11)]), "g", "v")


def test_exhaustive_bootstrap_of_ten_groups(spark):
    """All 10^10 samples, against the distribution of a sum of ten draws by convolution."""
    r = ev.exhaustive_interval(frame(spark, "g int, v double", [(i, float(i * i)) for i in range(10)]), "g", "v").first()
    ways = {0: 1}
    for _ in range(10):
        grown: dict = {}
        for total, n in ways.items():
            for i in range(10):
                grown[total + i * i] = grown.get(total + i * i, 0) + n
        ways = grown
    sums = sorted(ways)
    upto = np.cumsum([ways[s] for s in sums])

    def quantile(p):
        place = p * (10 ** 10 - 1)
        low, high = (sums[int(np.searchsorted(upto, k, side="right"))] / 10 for k in (math.floor(place), math.ceil(place)))
        return low + (high - low) * (place - math.floor(place))

    assert r.resample_count == 10 ** 10 and r["mean"] == pytest.approx(28.5)
    assert (r.lower, r.upper) == (pytest.approx(quantile(0.025)), pytest.approx(quantile(0.975)))


def test_monte_carlo_shares_draws_between_keys(spark):
    """Keys of one size draw alike; every mean is that of the hashed draws."""
    import hashlib

    groups = {"a": [1.0, 2.0, 4.0], "b": [-1.0, 0.0, 9.0], "c": [3.0, 5.0]}
    rows = [(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)]
    got = {r.k: r for r in ev.monte_carlo_interval(frame(spark, "k string, g int, v double", rows), ["k"], "g", "v", 200, "s").collect()}
    for key, values in groups.items():
        n = len(values)
        draw = lambda r, j: int(hashlib.sha256(f"s|{r}|{j}".encode()).hexdigest()[:12], 16) % n  # noqa: E731, B023
        means = [np.mean([values[draw(r, j)] for j in range(n)]) for r in range(200)]
        assert got[key].group_count == n and got[key].resample_count == 200 and got[key]["mean"] == pytest.approx(np.mean(values))
        assert (got[key].lower, got[key].upper) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))


def test_regime_rule(spark):
    df = frame(spark, "t double, c double, p double", [(1.0, 9.0, 9.0), (2.0, 0.0, 0.0), (2.0, 5.0, 0.0), (2.0, 0.0, 5.0), (3.0, 5.0, 5.0)])
    rule = ev.apply_rule([("t", 2.0, 0), ("c", 5.0, 1), ("p", 5.0, 1)])
    assert [r[0] for r in df.select(rule).collect()] == [False, False, True, True, True]


def test_ofat_settings():
    assert [s[0] for s in ev.ofat_settings((3, 5, 7), (500, 1000, 1500), 5, 1000)] == ["h3nm_v1000ft", "h5nm_v500ft", "h5nm_v1000ft", "h5nm_v1500ft", "h7nm_v1000ft"]
    with pytest.raises(ValueError):
        ev.ofat_settings((3, 5), (500,), 4, 500)


def test_capacity_projection(spark):
    measured = frame(spark, "airport string, sample_rows long, population_rows long, direct_bytes long", [("A", 3, 10, 100), ("B", 7, 20, 50)])
    r = ev.project_capacity(measured, frame(spark, "shared long", [(11,)]), 400, 70, 100, 10**12, 0).first()
    # Shared 11 splits 3.3 / 7.7 -> 3 and 8; finalized = ceil(103*10/3 + 58*20/7).
    assert r.sample_bytes == 161 and r.finalized_bytes == math.ceil(103 * 10 / 3 + 58 * 20 / 7)
    assert r.peak_bytes == math.ceil(r.finalized_bytes * (1 + 400 / 161)) and r.memory_ok and r.disk_ok


def test_apportion_with_binding_capacity(spark):
    rows = [("g", "a", 100, 5, 30), ("g", "b", 50, 50, 30), ("g", "c", 10, 1, 30), ("h", "x", 7, 7, 3), ("h", "y", 7, 7, 3)]
    df = frame(spark, "g string, key string, population long, capacity long, total long", rows)
    got = {(r.g, r.key): r.allocated for r in sel.apportion(df, "g", "key").collect()}
    assert got == {("g", "a"): 5, ("g", "b"): 24, ("g", "c"): 1, ("h", "x"): 2, ("h", "y"): 1}
    with pytest.raises(ValueError):
        sel.apportion(df.withColumn("total", F.lit(10_000).cast("long")), "g", "key")


def test_systematic_midpoints(spark):
    for n, q in ((10, 3), (7, 7), (100, 1), (23, 9), (5, 2)):
        df = spark.range(1, n + 1)
        got = [r.id for r in df.filter(sel.systematic_midpoint(df.id, F.lit(n).cast("long"), F.lit(q).cast("long"))).orderBy("id").collect()]
        assert got == [(2 * j + 1) * n // (2 * q) + 1 for j in range(q)]


def test_group_splits(spark):
    df = frame(spark, "a string, d string", [("x", f"d{i}") for i in range(10)] + [("y", f"d{i}") for i in range(3)])
    counts = {(r.a, r.split): r["count"] for r in sel.group_splits(df, ["a"], "d", "salt").groupBy("a", "split").count().collect()}
    assert counts == {("x", "train"): 6, ("x", "validation"): 2, ("x", "test"): 2, ("y", "train"): 1, ("y", "validation"): 1, ("y", "test"): 1}


def test_track_deltas_reject_equal_times(spark):
    df = frame(spark, "t string, us long, v double", [("a", 1, 1.0), ("a", 1, 2.0)])
    with pytest.raises(Exception, match="not increasing"):
        sel.track_deltas(df, ["t"], "us", ["v"]).collect()


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2)) * [1.0, 3.0] + [0.0, 5.0]
    mu = np.exp(0.3 + 0.5 * x[:, 0] - 0.1 * x[:, 1])
    y = rng.poisson(mu * rng.gamma(2.5, 1 / 2.5, 600))
    data = [(float(a), float(b), int(c), int(c >= 2)) for (a, b), c in zip(x, y)]
    return x, y, spark.createDataFrame(data, "a double, b double, y long, r int").repartition(4).cache()


def test_ridge_closed_form(spark, counts):
    x, y, df = counts
    z = (x - x.mean(0)) / x.std(0)
    t = np.log1p(y)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (t - t.mean()))
    model = M.fit_ridge_log1p(df, ["a", "b"], "y")
    assert np.array(model.coefficients) * x.std(0) == pytest.approx(w, rel=1e-8)
    mine = np.array([r[0] for r in df.orderBy("a").select(model.predict()).collect()])
    want = np.maximum(np.expm1(t.mean() + z @ w), 0)[np.argsort(x[:, 0])]
    assert mine == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_poisson_and_logistic_are_stationary(spark, counts):
    x, y, df = counts
    z = (x - x.mean(0)) / x.std(0)
    m = M.fit_poisson(df, ["a", "b"], "y")
    mu = np.exp(m.intercept + x @ np.array(m.coefficients))
    assert np.abs(np.column_stack([np.ones(600), z]).T @ (y - mu)).max() < 1e-2
    g = M.fit_logistic(df, ["a", "b"], "r")
    p = 1 / (1 + np.exp(-(g.intercept + x @ np.array(g.coefficients))))
    w = np.array(g.coefficients) * x.std(0)
    assert np.abs(z.T @ ((y >= 2) - p) - w).max() < 1e-2 and abs(((y >= 2) - p).sum()) < 1e-2


def test_nb2_fit_is_a_maximum(spark, counts):
    x, y, df = counts
    model, fit = M.fit_nb2(df, ["a", "b"], "y")

    def nll(i, w, alpha):
        mu, s = np.exp(i + x @ w), 1 / alpha
        return -np.mean([math.lgamma(k + s) - math.lgamma(s) - math.lgamma(k + 1) + s * math.log(s / (s + m)) + k * math.log(m / (s + m)) for k, m in zip(y, mu)])

    w = np.array(model.coefficients)
    best = nll(model.intercept, w, model.dispersion)
    assert fit["converged"] and fit["iterations"] <= 15 and fit["objective"] == pytest.approx(best, rel=1e-9)
    for di, dw, da in ((0.02, 0, 1), (-0.02, 0, 1), (0, 0.01, 1), (0, -0.01, 1), (0, 0, 1.05), (0, 0, 0.95)):
        assert nll(model.intercept + di, w + dw, model.dispersion * da) >= best - 1e-9


def test_calibration_line(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 2000)
    y = rng.uniform(size=2000) < 1 / (1 + np.exp(-(0.4 + 0.7 * np.log(p / (1 - p)))))
    line = M.calibration_line(frame(spark, "p double, y int", [(float(a), int(b)) for a, b in zip(p, y)]), "y", "p")
    z = np.log(p / (1 - p))
    q = 1 / (1 + np.exp(-(line["intercept"] + line["slope"] * z)))
    assert line["converged"] and abs((q - y).mean()) < 1e-6 and abs(((q - y) * z).mean()) < 1e-6
