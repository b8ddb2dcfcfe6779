import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteseries.functions import special as S
from siteseries.stats import compare, correlation, mixed, ordination, path, permute, regression, smooth


def frame(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=["a", "b", "c", "y"])
    pdf["y"] = 1.0 + 2.0 * pdf.a - pdf.b + 0.5 * pdf.y
    pdf["g"] = np.where(rng.random(n) < 0.6, "hot", "cold")
    return pdf, spark.createDataFrame(pdf)


def ols(x, y):
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rss = ((y - design @ beta) ** 2).sum()
    df = len(y) - design.shape[1]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss / df)
    return beta, se, rss, df


def test_multiple_ols_by_group(spark):
    pdf, df = frame(spark)
    got = regression.multiple_ols(df, ["g"], ["a", "b", "c"], "y").toPandas()
    for g, part in pdf.groupby("g"):
        beta, se, _, dof = ols(part[["a", "b", "c"]].to_numpy(), part.y.to_numpy())
        mine = got[got.g == g].set_index("term").loc[["(Intercept)", "a", "b", "c"]]
        assert np.allclose(mine.estimate, beta) and np.allclose(mine.std_error, se)
        assert np.allclose(mine.p_value, S.t_two_sided(beta / se, dof))


def test_simple_ols_statistics_agree(spark):
    pdf, df = frame(spark)
    r = regression.simple_ols(df, [], "a", "y").first()
    beta, se, _, _ = ols(pdf[["a"]].to_numpy(), pdf.y.to_numpy())
    assert r.slope == pytest.approx(beta[1]) and r.std_error == pytest.approx(se[1])
    assert r.f_stat == pytest.approx((beta[1] / se[1]) ** 2)


def test_quadratic_fit(spark):
    x = np.arange(20.0)
    pdf = pd.DataFrame({"g": "a", "x": x, "y": 3 + 2 * x - 0.5 * x * x})
    r = regression.quadratic_fit(spark.createDataFrame(pdf), ["g"], "x", "y").first()
    m = x.mean()
    assert (r.b2, r.b1, r.b0) == (pytest.approx(-0.5), pytest.approx(2 - m), pytest.approx(3 + 2 * m - 0.5 * m * m))


def test_stepwise_finds_a_local_best(spark):
    pdf, df = frame(spark)
    found = regression.stepwise_aic(df, "y", ["a", "b", "c"])

    def aic(names):
        if names:
            rss = ols(pdf[list(names)].to_numpy(), pdf.y.to_numpy())[2]
        else:
            rss = ((pdf.y - pdf.y.mean()) ** 2).sum()
        return len(pdf) * math.log(rss / len(pdf)) + 2 * (len(names) + 1)

    best = min((aic(s), s) for k in range(4) for s in itertools.combinations(["a", "b", "c"], k))
    assert found["aic"] == pytest.approx(best[0]) and sorted(found["terms"]) == sorted(best[1])


def test_correlations_are_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, 5.0, 5.0), (4.0, None, 2.0)], "a double, b double, c double")
    pdf = df.toPandas()
    got = {(r.x, r.y): r.r for r in correlation.correlation_pairs(df, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    for (x, y), v in got.items():
        assert v == pytest.approx(want.loc[x, y])
    wide = correlation.correlation_matrix(df, ["a", "b", "c"]).toPandas().set_index("term")
    assert math.isnan(wide.loc["b", "c"]) and wide.loc["c", "a"] == round(want.loc["c", "a"], 2)


def test_welch_anova_tukey(spark):
    pdf, df = frame(spark)
    pdf["s"] = np.where(pdf.c > 0.4, "x", np.where(pdf.c < -0.4, "z", "m"))
    df = spark.createDataFrame(pdf)
    r = compare.welch_vs_baseline(df, [], "s", "y", F.col("s") == "m").toPandas().set_index("s")
    b = pdf[pdf.s == "m"].y
    for s in ("x", "z"):
        v = pdf[pdf.s == s].y
        se2 = v.var() / len(v) + b.var() / len(b)
        dof = se2**2 / ((v.var() / len(v)) ** 2 / (len(v) - 1) + (b.var() / len(b)) ** 2 / (len(b) - 1))
        assert r.loc[s, "t_stat"] == pytest.approx((v.mean() - b.mean()) / math.sqrt(se2)) and r.loc[s, "df"] == pytest.approx(dof)
    a = compare.anova(df, [], "s", "y").first()
    ssw = sum(((p.y - p.y.mean()) ** 2).sum() for _, p in pdf.groupby("s"))
    sst = ((pdf.y - pdf.y.mean()) ** 2).sum()
    assert a.ss_within == pytest.approx(ssw) and a.ss_between == pytest.approx(sst - ssw)
    t = compare.tukey_pairs(df, [], "s", "y").toPandas()
    x, z = pdf[pdf.s == "x"].y, pdf[pdf.s == "z"].y
    q = abs(z.mean() - x.mean()) / math.sqrt(ssw / a.df_within / 2 * (1 / len(x) + 1 / len(z)))
    assert len(t) == 3 and t[(t.group_a == "x") & (t.group_b == "z")].q_stat.iloc[0] == pytest.approx(q)


def test_rank_sum_with_ties(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": 1, "g": rng.choice(["ref", "o"], 80), "v": rng.integers(0, 9, 80).astype(float)})
    r = compare.rank_sum_vs(spark.createDataFrame(pdf), ["k"], "g", "v", "ref", ["o"]).first()
    a, b = pdf[pdf.g == "ref"].v.to_numpy(), pdf[pdf.g == "o"].v.to_numpy()
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    ties = pdf.v.value_counts()
    n, n1, n2 = len(pdf), len(a), len(b)
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    assert r.u_stat == pytest.approx(u)
    assert r.z_stat == pytest.approx((u - n1 * n2 / 2 - math.copysign(0.5, u - n1 * n2 / 2)) / sd)


def test_normal_scores_unfold_ties(spark, monkeypatch):
    monkeypatch.setattr(compare, "SCORE_CHUNK", 3)
    df = spark.createDataFrame([("a", 1.0)] * 8 + [("a", 2.0)], "g string, v double")
    got = compare.normal_scores(df, ["g"], "v").orderBy("position").toPandas()
    assert got.position.tolist() == list(range(1, 10)) and (got.v.iloc[:8] == 1.0).all()
    assert got.score.iloc[4] == pytest.approx(0.0, abs=1e-9) and got.score.iloc[0] == pytest.approx(-got.score.iloc[8])


def test_shapiro_francia_tells_normal_from_skewed(spark):
    rng = np.random.default_rng(4)
    rows = [("n", float(v)) for v in rng.normal(size=300)] + [("e", float(v)) for v in rng.exponential(size=300)]
    got = {r.g: r for r in compare.shapiro_francia(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["n"].w_stat > 0.99 > got["e"].w_stat and got["e"].z_stat > 5 > abs(got["n"].z_stat)


def test_pca_against_numpy(spark):
    pdf, df = frame(spark)
    cols = ["a", "b", "c", "y"]
    fit = ordination.fit_pca(df, cols)
    z = (pdf[cols] - pdf[cols].mean()) / pdf[cols].std()
    values = np.linalg.eigvalsh(np.corrcoef(z.T))[::-1]
    assert np.allclose(fit.values, values) and fit.share.sum() == pytest.approx(1.0)
    scores = fit.scores(df, 2).toPandas()
    assert np.allclose(scores.axis1, (z @ fit.vectors[:, 0]))
    for i, c in enumerate(cols):
        assert np.corrcoef(scores.axis1, scores[c])[0, 1] == pytest.approx(fit.axis_correlations[i, 0])


def test_rda_against_dense_algebra(spark):
    rng = np.random.default_rng(6)
    n, taxa = 40, 7
    env = rng.normal(size=(n, 2))
    counts = np.floor(np.exp(rng.normal(size=(n, taxa)) + env[:, :1] * np.linspace(-1, 1, taxa)) * 3)
    counts[:, 0] += 1
    long = [(f"s{i}", f"t{j}", float(counts[i, j])) for i in range(n) for j in range(taxa) if counts[i, j] > 0]
    community = spark.createDataFrame(long, "uid string, lowest_taxon string, v double")
    table = spark.createDataFrame([(f"s{i}", float(env[i, 0]), float(env[i, 1])) for i in range(n)], "uid string, x double, z double")
    fit = ordination.fit_rda(community, table, ["x", "z"], "v", ["uid"])
    y = np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    y = y - y.mean(axis=0)
    x = env - env.mean(axis=0)
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    u, s, vt = np.linalg.svd(fitted, full_matrices=False)
    assert np.allclose(fit.values, s[:2] ** 2 / (n - 1)) and fit.total == pytest.approx((y**2).sum() / (n - 1))
    sites = fit.sites(1).toPandas().set_index("uid").loc[[f"s{i}" for i in range(n)]].axis1.to_numpy()
    assert min(np.abs(sites - y @ vt[0]).max(), np.abs(sites + y @ vt[0]).max()) < 1e-10
    lc = fit.fitted_sites(1).toPandas().set_index("uid").loc[[f"s{i}" for i in range(n)]].axis1.to_numpy()
    assert min(np.abs(lc - fitted @ vt[0]).max(), np.abs(lc + fitted @ vt[0]).max()) < 1e-10


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 64, 65, 1000):
        to = permute.permuted(np.arange(n), n, np.arange(1, 30, dtype=np.uint64))
        assert (np.sort(to, axis=0) == np.arange(n)[:, None]).all()
    # every row goes everywhere about equally often
    to = permute.permuted(np.arange(8), 8, np.arange(1, 4001, dtype=np.uint64))
    seen = np.stack([np.bincount(row, minlength=8) for row in to])
    assert np.abs(seen - 500).max() < 6 * np.sqrt(500)
    # as many different ones as random draws from all 40320 permutations would give
    assert abs(len({tuple(c) for c in to.T}) - 40320 * (1 - np.exp(-4000 / 40320))) < 80


def fits_by_brute_force(ids, axes, variables, permutations, seed):
    """r and p of each variable, by dense least squares on every permutation of the hash order."""
    from hashlib import md5

    order = sorted(range(len(ids)), key=lambda k: md5(f"{seed}|{ids[k]}".encode()).hexdigest())
    row = np.empty(len(ids), dtype=int)
    row[order] = np.arange(len(ids))
    keys = np.arange(1, permutations + 1, dtype=np.uint64) + np.uint64(seed << 20)
    to = permute.permuted(np.arange(len(ids)), len(ids), keys)
    by_row = np.empty_like(axes)
    by_row[row] = axes

    def r2(y, x):
        x = x - x.mean(axis=0)
        y = y - y.mean()
        return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / (y ** 2).sum()

    out = {}
    for name, y in variables.items():
        seen = r2(y, axes)
        made = [r2(y, by_row[to[row, k]]) for k in range(permutations)]
        out[name] = seen, (1 + sum(m >= seen - 1e-12 for m in made)) / (1 + permutations)
    return out


@pytest.mark.parametrize("part, held", [(1 << 22, 32 << 20), (17, 1)])
def test_fits_on_axes_equal_brute_force(spark, monkeypatch, part, held):
    """Also with scores in several parts and sums handed on at once."""
    monkeypatch.setattr(permute, "SCORES", part)
    monkeypatch.setattr(permute, "HELD", held)
    rng = np.random.default_rng(6)
    n = 60
    axes = rng.normal(size=(n, 2)) + 5
    variables = {"linked": axes[:, 0] - axes[:, 1] + 0.3 * rng.normal(size=n), "sparse": np.where(rng.random(n) < 0.2, rng.random(n), 0.0),
                 "loose": rng.normal(size=n) + 0.3 * axes[:, 0]}
    sites = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(axes)] + [(n, None, 1.0)], "id long, a double, b double")
    long = [(k, name, "x", float(v)) for name, y in variables.items() for k, v in enumerate(y) if v] + [(k, "flat", "x", 2.0) for k in range(n)]
    values = spark.createDataFrame(long + [(n, "linked", "x", 9.0), (0, "loose", "x", None)], "id long, variable string, kind string, v double").repartition(3)
    got = {r.variable: r for r in permute.fit_on_axes(sites, ["id"], ("a", "b"), values, 99, 7).collect()}
    want = fits_by_brute_force(list(range(n)), axes, variables, 99, 7)
    assert got.keys() == want.keys() | {"flat"} and got["flat"].r is None and got["flat"].p is None
    for name, (r, p) in want.items():
        assert got[name].r == pytest.approx(r) and got[name].p == pytest.approx(p) and got[name].nobs == n
        assert got[name].axis1 ** 2 + got[name].axis2 ** 2 == pytest.approx(1)
    assert got["linked"].p == pytest.approx(0.01) and got["linked"].axis1 > 0 > got["linked"].axis2
    none = permute.fit_on_axes(sites.limit(0), ["id"], ("a", "b"), values, 9).collect()
    assert all(r.r is None for r in none)


def test_sliced_ordination_equals_fits_of_the_slices(spark):
    rng = np.random.default_rng(4)
    rows, env = [], []
    for k in range(60):
        for taxon in range(6):
            if rng.random() < 0.6:
                rows.append((f"u{k}", f"t{taxon}", float(rng.integers(1, 9))))
        env.append((f"u{k}", float(rng.normal()), float(rng.normal()), ["even", "odd"][k % 2]))
    community = spark.createDataFrame(rows, "uid string, lowest_taxon string, v double")
    table = spark.createDataFrame(env, "uid string, x double, z double, part string")
    both = table.withColumn("slice", F.explode(F.array(F.lit("all"), "part"))).unionByName(
        table.limit(1).withColumn("slice", F.lit("one")), allowMissingColumns=True)
    got = {(r.slice, r.axis): r for r in ordination.rda_axes_by(community, both, ["x", "z"], "v", ["uid"], "slice").collect()}
    assert {s for s, _ in got} == {"all", "even", "odd"}
    for name, some in (("all", table), ("even", table.where("part = 'even'")), ("odd", table.where("part = 'odd'"))):
        fit = ordination.fit_rda(community, some, ["x", "z"], "v", ["uid"])
        for k in range(2):
            assert got[name, k + 1].eigenvalue == pytest.approx(fit.values[k]) and got[name, k + 1].n == fit.n
            assert got[name, k + 1].variation_explained == pytest.approx(fit.share[k])


def test_path_model(spark):
    rng = np.random.default_rng(8)
    n = 150
    r, rain = rng.normal(size=n), rng.normal(size=n)
    m = 0.7 * r + rng.normal(size=n)
    d = 0.3 * r + 0.5 * m + rng.normal(size=n)
    y = 0.4 * m - 0.6 * d + 0.2 * rain + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"r": r, "rain": rain, "m": m, "d": d, "out": y, "k": "s"}))
    params, fits = path.path_models(df, ["out"], ["m ~ r", "d ~ r + m", "OUTCOME ~ m + d + rain"], ["k"])
    est = {(p.response, p.predictor): p.estimate for p in params.collect()}
    assert np.allclose([est["out", v] for v in ("m", "d", "rain")], ols(np.column_stack([m, d, rain]), y)[0][1:])
    assert est["m", "r"] == pytest.approx(ols(r[:, None], m)[0][1])
    f = fits.first()
    assert f.df == 3 and 0 <= f.srmr < 0.2 and 0 <= f.cfi <= 1 and f.model_fit in ("Good", "Poor")
    # a saturated model reproduces the covariances exactly
    full, fit0 = path.solve_path(np.cov(np.vstack([m, r]), bias=True), ["m", "r"], path.parse(["m ~ r"]), n)
    assert fit0["df"] == 0 and fit0["chi2"] == pytest.approx(0.0, abs=1e-9) and fit0["srmr"] == pytest.approx(0.0, abs=1e-9)


def dense_reml(pdf, xs, slope, sd, rho, phi):
    """REML log-likelihood from full covariance matrices."""
    p = len(xs) + 1
    a, b, c, logdet, n = np.zeros((p, p)), np.zeros(p), 0.0, 0.0, 0
    for _, g in pdf.groupby("site"):
        x = np.column_stack([np.ones(len(g)), g[xs]])
        z = np.ones((len(g), 1)) if slope is None else np.column_stack([np.ones(len(g)), g[slope]])
        psi = np.diag(np.array(sd) ** 2)
        if len(sd) == 2:
            psi[0, 1] = psi[1, 0] = rho * sd[0] * sd[1]
        lag = np.abs(np.subtract.outer(np.arange(len(g)), np.arange(len(g))))
        v = (phi**lag if phi else np.eye(len(g))) + z @ psi @ z.T
        w = np.linalg.inv(v)
        a += x.T @ w @ x; b += x.T @ w @ g.y; c += g.y @ w @ g.y
        logdet += np.linalg.slogdet(v)[1]; n += len(g)
    beta = np.linalg.solve(a, b)
    s2 = (c - b @ beta) / (n - p)
    return -0.5 * ((n - p) * (math.log(2 * math.pi * s2) + 1) + logdet + np.linalg.slogdet(a)[1]), beta, s2


def mixed_data(seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(12):
        b0, b1, e = rng.normal(0, 1.0), rng.normal(0, 0.5), 0.0
        for t in range(int(rng.integers(6, 20))):
            x = rng.normal()
            e = 0.4 * e + rng.normal()
            rows.append(("m", f"s{s}", t, x, 1 + b0 + (0.8 + b1) * x + e))
    return pd.DataFrame(rows, columns=["k", "site", "t", "x", "y"])


def test_products_equal_dense_likelihood(spark):
    pdf = mixed_data()
    stats = mixed.group_products(spark.createDataFrame(pdf), ["k"], "site", "t", ["x"], "y").toPandas()
    n = stats.n.to_numpy()
    s0, si, s1 = (mixed._square(np.stack(stats[c].to_numpy()), 3) for c in ("s0", "si", "s1"))
    for slope, theta in ((None, [0.3, 0.5]), (None, [-1.0, 0.0]), ("x", [0.2, -0.4, 0.3, 0.25])):
        z = [0] if slope is None else [0, 1]
        v, logdet, _, _ = mixed._weighted(n, s0, si, s1, z, np.array(theta))
        got = mixed._reml(v.sum(axis=0), logdet.sum(), n.sum())
        sd = np.exp(theta[:len(z)])
        want, beta, s2 = dense_reml(pdf, ["x"], slope, sd, math.tanh(theta[2]) if slope else 0.0, math.tanh(theta[-1]))
        assert got["ll"] == pytest.approx(want, rel=1e-9) and np.allclose(got["beta"], beta) and got["s2"] == pytest.approx(s2)


@pytest.mark.parametrize("slope,ar1", [(None, False), (None, True), ("x", False)])
def test_mixed_search_reaches_the_maximum(spark, slope, ar1):
    pdf = mixed_data()
    fit = mixed.fit_mixed(spark.createDataFrame(pdf), ["k"], "site", "t", ["x"], "y", slope=slope, ar1=ar1)
    s = fit.summary.first()
    rng = np.random.default_rng(0)
    best = -np.inf
    for _ in range(400):
        sd = np.exp(rng.normal(0, 0.7, 2 if slope else 1)) * np.array([s.sd_intercept, s.sd_slope] if slope else [s.sd_intercept]) / s.sigma
        phi = float(np.clip((s.phi or 0) + rng.normal(0, 0.1), -0.9, 0.9)) if ar1 else 0.0
        best = max(best, dense_reml(pdf, ["x"], slope, sd, float(rng.uniform(-0.9, 0.9)) if slope else 0.0, phi)[0])
    assert s.loglik >= best - 0.02
    effects = fit.effects.toPandas()
    assert len(effects) == 12 and abs(effects.intercept_effect.mean()) < 0.2
    if not slope and not ar1:
        data = spark.createDataFrame(pdf)
        res = mixed.residuals(data, fit, ["k"], "site", ["x"], "y").toPandas()
        assert len(res) == len(pdf) and np.allclose(res.fitted + res.residual, res.y)
        assert res.residual.std() < pdf.y.std() and abs(res.residual.mean()) < 0.05
    if slope:
        lines = pdf.groupby("site").apply(lambda g: np.polyfit(g.x, g.y, 1)[0], include_groups=False)
        assert np.corrcoef(effects.set_index("site").slope.sort_index(), lines.sort_index())[0, 1] > 0.9


def test_loess_reproduces_quadratics_and_counts_duplicates(spark):
    x = np.arange(30.0)
    y = 2 + x - 0.1 * x * x
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": np.repeat(x, 2), "y": np.repeat(y, 2) + np.tile([0.5, -0.5], 30)}))
    got = smooth.loess(df, ["g"], "x", "y", span=0.4, points=15).toPandas()
    assert np.allclose(got.fitted, 2 + got.x - 0.1 * got.x**2)


@pytest.mark.parametrize("span, degree", [(0.2, 2), (0.75, 2), (0.4, 1), (1.0, 2), (1.5, 2)])
def test_long_series_equal_one_call(spark, monkeypatch, span, degree):
    rng = np.random.default_rng(11)
    n = 900
    x = np.concatenate([rng.normal(0, 1, n // 3), 50 + rng.exponential(3, n // 3), np.round(rng.uniform(-20, 80, n // 3))])
    pdf = pd.DataFrame({"g": np.repeat([None, "b", "c"], n // 3)[rng.permutation(n)], "x": x, "y": np.sin(x / 9) + rng.normal(0, 0.2, n)})
    df = spark.createDataFrame(pdf, "g string, x double, y double")
    df = df.unionByName(spark.createDataFrame([("one", 3.0, 7.0), ("one", 3.0, 9.0), ("b", None, 1.0), ("c", 1.0, None), ("c", float("nan"), 1.0)], df.schema))
    monkeypatch.setattr("siteseries.stats.local.long_series.__defaults__", (16,))
    plain, binned = (smooth.loess(df, ["g"], "x", "y", span, 30, degree, size).toPandas().fillna({"g": ""}).sort_values(["g", "x"]).reset_index(drop=True)
                     for size in (10**6, 100))
    assert len(plain) == len(binned) == 91 and (plain.g == binned.g).all() and np.allclose(plain.x, binned.x)
    assert np.allclose(plain.fitted, binned.fitted, atol=1e-7)


def test_long_series_of_few_values_and_of_times(spark, monkeypatch):
    monkeypatch.setattr("siteseries.stats.local.long_series.__defaults__", (4,))
    heavy = spark.createDataFrame([(float(min(k, 5)), 1.0 * k) for k in range(100)], "x double, y double")  # most rows at one place
    a, b = (smooth.loess(heavy, [], "x", "y", 0.3, 11, 2, size).orderBy("x").toPandas() for size in (100, 3))
    assert np.allclose(a.fitted, b.fitted, equal_nan=True)
    times = spark.range(200).selectExpr("timestamp_seconds(1700000000 + id * 60) AS t", "cast(id AS decimal(9,2)) AS y")
    got = smooth.loess(times, [], "t", "y", 0.4, 20, 2, 50).toPandas()
    assert np.allclose(got.fitted, (got.x - 1700000000) / 60, atol=1e-6)
    assert smooth.loess(times.where("y < 0"), [], "t", "y").count() == 0


def test_kernel_density_equals_the_sum_of_all_kernels(spark):
    rng = np.random.default_rng(3)
    far = np.r_[rng.normal(0, 1, 400), rng.normal(300, 1, 30), 1e4]  # gaps far wider than a bandwidth
    groups = {"a": rng.normal(5, 2, 500), "b": far, None: np.r_[np.repeat(1.0, 40), rng.exponential(3, 60)], "one": np.array([2.0]), "same": np.ones(9)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    got = smooth.kernel_density(spark.createDataFrame(rows, "g string, y double"), ["g"], "y", points=50).collect()
    assert {r.g for r in got} == {"a", "b", None} and len(got) == 150
    for g in ("a", "b", None):
        v = groups[g]
        bw = 0.9 * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2
        mine = sorted((r.point, r.x, r.density) for r in got if r.g == g)
        x = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 50)
        want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
        np.testing.assert_allclose([m[1] for m in mine], x, rtol=1e-12)
        np.testing.assert_allclose([m[2] for m in mine], want, rtol=0, atol=1e-11 / bw)
    assert smooth.kernel_density(spark.createDataFrame([], "g string, y double"), ["g"], "y").count() == 0


def test_kernel_density_integrates_to_one(spark):
    _, df = frame(spark, 300)
    got = smooth.kernel_density(df, ["g"], "y", points=200).toPandas()
    for _, p in got.groupby("g"):
        p = p.sort_values("point")
        assert np.trapezoid(p.density, p.x) == pytest.approx(1.0, abs=0.01)


def test_histogram_and_box(spark):
    pdf, df = frame(spark)
    h = smooth.histogram(df, ["a", "b"], 10).groupBy("variable").agg(F.sum("n").alias("n"), F.max("bin").alias("top")).collect()
    assert all(r.n == len(pdf) and r.top == 9 for r in h)
    b = smooth.box_stats(df, ["g"], "y").toPandas().set_index("g")
    for g, p in pdf.groupby("g"):
        lo, hi = p.y.quantile(0.25), p.y.quantile(0.75)
        inside = p.y[(p.y >= lo - 1.5 * (hi - lo)) & (p.y <= hi + 1.5 * (hi - lo))]
        assert (b.loc[g, "whisker_low"], b.loc[g, "whisker_high"]) == (inside.min(), inside.max())
        assert b.loc[g, "outliers"] == len(p) - len(inside)


def test_points_inside_the_extremes_are_dropped_and_no_corner_is(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": np.where(rng.random(5000) < 0.9, "hot", "b"), "x": 1e6 + rng.normal(size=5000), "y": rng.normal(size=5000)})
    more = pd.DataFrame({"g": ["line"] * 4 + ["one", "two", "two"] + ["square"] * 5, "x": [0, 1, 2, 3, 5, 1, 1, 0, 0, 1, 1, 0.5], "y": [0, 1, 2, 3, 5, 1, 2, 0, 1, 0, 1, 0.5]})
    pdf = pd.concat([pdf, more.astype({"x": float, "y": float})])
    left = smooth.outer_points(spark.createDataFrame(pdf), ["g"]).toPandas()
    assert len(left) < 400
    kept = set(map(tuple, left[["g", "x", "y"]].to_numpy()))
    for g, p in pdf.groupby("g"):
        assert {(g, *c) for c in smooth._hull(p[["x", "y"]].to_numpy())} <= kept


def test_convex_hull_contains_every_point(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": np.where(rng.random(2000) < 0.9, "hot", "b"), "x": rng.normal(size=2000), "y": rng.normal(size=2000)})
    got = smooth.convex_hull(spark.createDataFrame(pdf).repartition(6), ["g"], "x", "y").toPandas()
    for g, p in pdf.groupby("g"):
        c = got[got.g == g].sort_values("corner")[["x", "y"]].to_numpy()
        for a, b in zip(c, np.roll(c, -1, axis=0)):
            side = (b[0] - a[0]) * (p.y - a[1]) - (b[1] - a[1]) * (p.x - a[0])
            assert side.min() > -1e-9


def test_correlation_with_a_column_that_does_not_vary(spark):
    rows = [("a", 5.0, 1.0, 2.0), ("a", 5.0, 2.0, 1.0), ("a", 5.0, 4.0, None), ("b", 1.0, 1.0, 2.0), ("b", 2.0, 3.0, 1.0), ("b", 4.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, flat double, x double, y double")
    got = {(r.g, r.x, r.y): r.r for r in correlation.target_correlations(df.select("g", "flat", "x"), ["flat"], ["x"], ["g"]).collect()}
    assert got["a", "flat", "x"] is None and got["b", "flat", "x"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 3, 4])[0, 1])
    got = {(r.g, r.x, r.y): r.r for r in correlation.correlation_pairs(df, ["flat", "x", "y"], ["g"]).collect()}
    assert got["a", "x", "flat"] is None and got["a", "y", "x"] == pytest.approx(-1.0)
