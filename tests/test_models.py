import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteseries.models import engines, features, gram, neighbours, resample, search


def rows(spark, n=600):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(n), "s": np.where(rng.random(n) < 0.7, "hot", "b"), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf["y"] = 2 * pdf.x - pdf.z + 0.1 * rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf)


def test_split_is_exact_and_stable(spark):
    _, df = rows(spark)
    out = resample.stratified_split(df, ["id"], ["s"], 0.8)
    for r in out.groupBy("s").agg(F.sum((F.col("part") == "train").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).collect():
        assert r.t == int(r.n * 0.8)
    again = resample.stratified_split(df.repartition(5), ["id"], ["s"], 0.8)
    assert out.select("id", "part").exceptAll(again.select("id", "part")).count() == 0


def test_folds_are_balanced_and_cover_all_rows(spark):
    pdf, df = rows(spark)
    out = resample.repeated_folds(df, ["id"], 7, 3).groupBy("repeat", "fold").count().toPandas()
    assert len(out) == 21 and out["count"].max() - out["count"].min() <= 1 and out["count"].sum() == 3 * len(pdf)


def test_bootstrap_weights_are_poisson(spark):
    pdf, df = rows(spark)
    out = resample.bootstrap_weights(df, ["id"], 30).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    total = 30 * len(pdf)
    assert out.w / total == pytest.approx(1.0, abs=0.03) and out.n / total == pytest.approx(1 - np.exp(-1), abs=0.02)


def test_bootstrap_draws_are_exactly_n_and_order_free(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS g")
    out = resample.bootstrap_draws(df, ["id"], 10, leaf=256).cache()
    sums = [r["w"] for r in out.groupBy("resample").agg(F.sum("weight").alias("w")).collect()]
    assert sums == [5000] * 10 and out.columns == ["id", "g", "resample", "weight"]
    other = resample.bootstrap_draws(df.repartition(7, "g"), ["id"], 10, leaf=1 << 14)  # other parts of the tree, other tasks
    assert out.exceptAll(other).isEmpty() and other.count() == out.count()
    more = resample.bootstrap_draws(df, ["id"], 12, leaf=256).where("resample <= 10")  # more resamples leave the first ones as they are
    assert out.exceptAll(more).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_bootstrap_draws_of_few_rows(spark, n):
    df = spark.range(n).selectExpr("id", "cast(null AS string) AS resample_of")
    out = resample.bootstrap_draws(df, ["id"], 6).groupBy("resample").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in out] == [n] * (6 if n else 0)


def test_bootstrap_draws_share_keys_and_follow_the_multinomial(spark):
    df = spark.range(40).selectExpr("id % 20 AS k", "id")
    drawn = resample.bootstrap_draws(df, ["k"], 2000, leaf=4).toPandas()
    assert (drawn.groupby(["resample", "k"]).weight.nunique() == 1).all() and (drawn.groupby("resample").weight.sum() == 40).all()
    counts = drawn[drawn.id < 20].pivot(index="resample", columns="k", values="weight").fillna(0).to_numpy()
    assert counts.sum() == 20 * 2000
    assert ((counts.mean(axis=0) - 1) ** 2 / (0.95 / 2000)).sum() < 45          # chi-square, 19 degrees of freedom
    assert counts.var(axis=0).mean() == pytest.approx(0.95, abs=0.03)            # n p (1 - p)
    pairs = np.corrcoef(counts.T)[np.triu_indices(20, 1)]
    assert pairs.mean() == pytest.approx(-1 / 19, abs=0.01) and np.abs(pairs + 1 / 19).max() < 0.1


@pytest.mark.parametrize("d, left, right", [(1, 3, 5), (7, 1, 1), (300, 8, 3), (20_000, 16, 16), (3_000_000, 5, 2)])
def test_left_draws_are_binomial_quantiles(d, left, right):
    u = (np.arange(4000) + 0.5) / 4000
    got = resample._left_draws(np.full(4000, d, np.int64), u, left, right)
    p = left / (left + right)
    assert got.min() >= 0 and got.max() <= d and (np.diff(got) >= 0).all()
    assert got.mean() == pytest.approx(d * p, rel=2e-3) and got.var() == pytest.approx(d * p * (1 - p), rel=2e-2, abs=1e-3)
    if d <= 300:
        pmf = np.array([math.comb(d, k) * p**k * (1 - p) ** (d - k) for k in range(d + 1)])
        assert np.array_equal(got, np.minimum(np.searchsorted(np.cumsum(pmf), u, side="right"), d))


def test_knn_blocks_match_brute_force(spark):
    pdf, df = rows(spark)
    train, test = df.filter("id < 450"), df.filter("id >= 450")
    a, b = pdf[pdf.id >= 450], pdf[pdf.id < 450]
    d = np.sqrt(((a[["x", "z"]].to_numpy()[:, None] - b[["x", "z"]].to_numpy()[None]) ** 2).sum(axis=2))
    pick = np.argsort(d, axis=1)[:, :4]
    w = 1 / (np.take_along_axis(d, pick, 1) + 1e-9)
    want = (w * b.y.to_numpy()[pick]).sum(axis=1) / w.sum(axis=1)
    for block in (10**6, 100):
        got = neighbours.knn_regression(train, test, ["id"], ["x", "z"], "y", 4, block).orderBy("id").toPandas()
        assert np.allclose(got.prediction, want)


def test_knn_measures_few_rows_of_a_block():
    """The nearest rows and distances are those of all pairs, bit by bit; where nothing clusters, few pairs are measured."""
    rng = np.random.default_rng(7)
    for n in range(200):
        a, b = rng.normal(size=(rng.integers(1, 30), 6)), rng.normal(size=(rng.integers(1, 200), 6))
        a, b = [(a, b), (a.round(), b.round()), (a + 1e8, b + 1e8), (a, np.tile(a[:1], (len(b), 1))), (a, b)][n % 5]
        if n % 5 == 4:
            b[0, 0] = (np.inf, np.nan, 1e170, 1e10)[n // 5 % 4]
        k, scale = int(rng.integers(1, 9)), 10.0 ** rng.integers(-160, 140)
        with np.errstate(all="ignore"):
            d = neighbours.distances(a * scale, b * scale)
            pick = np.argsort(d, axis=1, kind="stable")[:, :k]
            row, col, got = neighbours.nearest_rows(a * scale, b * scale, k)
        assert np.array_equal(row, np.repeat(np.arange(len(a)), min(k, len(b)))) and np.array_equal(col, pick.ravel())
        assert np.array_equal(got, np.take_along_axis(d, pick, axis=1).ravel(), equal_nan=True)
    a, b = rng.normal(size=(50, 63)), rng.normal(size=(5000, 63))
    assert len(neighbours.may_be_nearest(a, b, 5)[0]) < 0.01 * len(a) * len(b)


def test_knn_prunes_cells_of_clustered_rows(spark, monkeypatch):
    """Exact with under a tenth of the pairs compared where rows cluster, whatever the blocks; equal rows go by key."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 100, (40, 4))
    x = (centre[rng.integers(0, 40, 3000)] + rng.normal(0, 1, (3000, 4))).round(2)
    x[100:140] = x[100]
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(3000).astype(str), y=rng.normal(size=3000))
    train, test = pd.concat([pdf[300:], pdf[100:140]]), pdf[:300]
    train = train.sort_values("id", kind="stable").reset_index(drop=True)
    d = neighbours.distances(test[list("abcd")].to_numpy(), train[list("abcd")].to_numpy())
    pick = np.argsort(d, axis=1, kind="stable")[:, :5]
    w = 1 / (np.take_along_axis(d, pick, 1) + 1e-9)
    want = dict(zip(test.id, (w * train.y.to_numpy()[pick]).sum(axis=1) / w.sum(axis=1)))
    seen, plain = [], neighbours.further_cells
    monkeypatch.setattr(neighbours, "further_cells", lambda tests, radius: seen.append(plain(tests, radius)) or seen[-1])
    for block in (10**6, 50):
        got = neighbours.knn_regression(spark.createDataFrame(train), spark.createDataFrame(test), ["id"], list("abcd"), "y", 5, block, 64).collect()
        assert len(got) == 300 and all(np.isclose(r.prediction, want[r.id]) for r in got)
    visits = 300 + seen[0].count()
    assert visits / (300 * 64) < 0.1, visits
    empty = neighbours.knn_regression(spark.createDataFrame(train).limit(0), spark.createDataFrame(test), ["id"], list("abcd"), "y", 5)
    assert empty.count() == 0 and empty.columns == ["id", "prediction"]


def test_grid_ranks_the_right_model_first(spark):
    _, df = rows(spark)
    df = resample.repeated_folds(df, ["id"], 2, 1).cache()
    wfs = search.workflow_grid({"both": ["x", "z"], "one": ["z"]}, {"std": features.standard_features}, {"net": engines.elastic_net("y", 0.0, 0.0)})
    assert set(wfs) == {"both_std_net", "one_std_net"}
    metrics = search.fold_metrics(df, wfs, "y", 2).cache()
    ranked = search.rank_models(search.collect_metrics(metrics)).orderBy("rank").collect()
    assert ranked[0].model == "both_std_net" and ranked[0].n == 2 and ranked[0]["mean"] < 0.2
    wide = search.wide_fold_metric(metrics, list(wfs))
    assert wide.count() == 2 and set(wide.columns) == {"repeat", "fold", *wfs}


def test_final_fit_tune_and_importance(spark):
    _, df = rows(spark)
    parts = resample.stratified_split(df, ["id"], ["s"], 0.8).cache()
    model, metrics = search.finalise(parts, features.workflow(features.standard_features(["x", "z"]), engines.tree("y")), "y")
    assert metrics.first().rsq > 0.7
    names = [n for n, _ in search.importance(model, ["x", "z"])]
    assert names[0] == "x"
    engine = engines.elastic_net("y")
    tuned = search.tune(resample.repeated_folds(df, ["id"], 2, 1), features.workflow(features.standard_features(["x", "z"]), engine),
                        {engine.regParam: [0.0, 50.0]}, "y", folds=2)
    assert tuned.avgMetrics[0] < tuned.avgMetrics[1]


def test_normalise_uses_training_rows_only(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (100.0, "test")], "x double, part string")
    got = [r.x for r in features.normalise(df, ["x"], F.col("part") == "train").collect()]
    assert got[:2] == [pytest.approx(-(0.5**0.5)), pytest.approx(0.5**0.5)] and got[2] == pytest.approx(98 / 2**0.5)
    out, cols = features.polynomial(spark.createDataFrame([(2.0, 3.0)], "a double, b double"), ["a", "b"])
    assert cols == ["a", "b", "a_p2", "b_p2", "a_x_b"] and tuple(out.select(cols).first()) == (2.0, 3.0, 4.0, 9.0, 6.0)


def test_observed_minus_expected(spark):
    pdf, df = rows(spark)
    wf = features.workflow(features.standard_features(["x", "z"]), engines.elastic_net("y", 0.0, 0.0))
    events = spark.createDataFrame([("hot", 2.0), ("cold", 5.0), (None, 3.0)], "s string, flood double")
    nulls = df.unionByName(df.limit(1).withColumn("s", F.lit(None).cast("string")))
    out = search.observed_minus_expected(nulls, wf, "y", F.col("s") == "hot", events, ("flood",)).toPandas()
    assert len(out) == len(pdf) + 1 and out.residual.std() == pytest.approx(0.1, abs=0.03)
    assert out[out.s == "hot"].ln_flood.to_numpy() == pytest.approx(np.log(2)) and out[out.s == "b"].ln_flood.isna().all()
    assert out[out.s.isna()].ln_flood.to_numpy() == pytest.approx(np.log(3))


def direct_elastic_net(x, y, penalty, mixture):
    """Plain proximal gradient on the rows, predictors scaled to unit variance."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    z, t = (x - mu) / sd, y - y.mean()
    step, b = 1 / (np.linalg.eigvalsh(z.T @ z / len(y)).max() + penalty), np.zeros(x.shape[1])
    for _ in range(20_000):
        g = b - step * (z.T @ (z @ b - t) / len(y) + penalty * (1 - mixture) * b)
        b = np.sign(g) * np.maximum(np.abs(g) - step * penalty * mixture, 0)
    return y.mean() - (b / sd) @ mu, b / sd


def test_gram_search_equals_direct_fits(spark):
    rng = np.random.default_rng(8)
    n = 200
    pdf = pd.DataFrame({"id": np.arange(n), "a": 1e4 + rng.normal(size=n), "b": rng.normal(size=n), "same": np.ones(n)})
    pdf["c"] = 0.7 * pdf.b + 0.5 * rng.normal(size=n)
    pdf["y"] = 3 * pdf.a - 2 * pdf.b + rng.normal(size=n) + 50
    gone = pd.DataFrame({"id": [n, n + 1], "a": [None, 1.0], "b": [1.0, 1.0], "same": [1.0, 1.0], "c": [1.0, 1.0], "y": [1.0, None]})
    df = resample.repeated_folds(spark.createDataFrame(pdf), ["id"], 4, 2)
    folds = df.select("id", "repeat", "fold").toPandas()
    more = spark.createDataFrame(gone, "id long, a double, b double, same double, c double, y double")
    more = more.selectExpr(*[f"{c}" for c in pdf.columns], "1 AS repeat", "1 AS fold")
    flows = {"all": ["a", "b", "c", "same"], "two": ["b", "c"], "none": ["same"]}
    configs = [(0.0, 1.0), (0.3, 1.0), (0.3, 0.0), (0.5, 0.5)]
    got = gram.search(df.unionByName(more), flows, "y", configs).collect()
    assert len(got) == 3 * 4 * 8
    for r in got:
        held = set(folds[(folds.repeat == r.repeat) & (folds.fold == r.fold)].id)
        train, test = pdf[~pdf.id.isin(held)], pdf[pdf.id.isin(held)]
        assert r.n == len(test)
        cols = [c for c in flows[r.model] if c != "same"]
        if cols:
            off, b = direct_elastic_net(train[cols].to_numpy(), train.y.to_numpy(), r.penalty, r.mixture)
            guess = off + test[cols].to_numpy() @ b
            assert np.allclose(r.slopes[:len(cols)], b, atol=1e-6)
            assert r.rsq == pytest.approx(np.corrcoef(guess, test.y)[0, 1] ** 2, abs=1e-5)
        else:
            guess = np.full(len(test), train.y.mean())
            assert r.rsq is None
        assert r.rmse == pytest.approx(np.sqrt(np.mean((test.y - guess) ** 2)), rel=1e-5)


def test_gram_search_without_rows_or_training_rows(spark):
    schema = "x double, y double, repeat int, fold int"
    assert gram.search(spark.createDataFrame([], schema), {"m": ["x"]}, "y", [(0.0, 0.0)]).count() == 0
    (row,) = gram.search(spark.createDataFrame([(1.0, 2.0, 1, 1), (2.0, 3.0, 1, 1)], schema), {"m": ["x"]}, "y", [(0.0, 0.0)]).collect()
    assert row.rmse is None and row.slopes is None and row.n == 2


def test_wide_grams_take_several_aggregates(spark, monkeypatch):
    monkeypatch.setattr(gram, "CHUNK", 4)
    _, df = rows(spark)
    df = resample.repeated_folds(df, ["id"], 3, 1)
    a = gram.search(df, {"m": ["x", "z"]}, "y", [(0.0, 0.0)]).orderBy("fold").collect()
    monkeypatch.setattr(gram, "CHUNK", 150)
    b = gram.search(df, {"m": ["x", "z"]}, "y", [(0.0, 0.0)]).orderBy("fold").collect()
    assert len(a) == 3 and all(p.rmse == pytest.approx(q.rmse) and p.slopes == pytest.approx(q.slopes) for p, q in zip(a, b))


@pytest.mark.parametrize("degree", [1, 2, 4])
def test_orthogonal_polynomials_are_orthonormal_on_the_training_rows(spark, degree):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(300), "x": 1e5 + 10 * rng.gamma(2.0, size=300), "two": rng.integers(0, 2, 300).astype(float)})
    train = pdf.id % 3 > 0
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(300, None, 1.0)], "id long, x double, two double"))
    out, cols = features.orthogonal_polynomial(df, ["x", "two"], F.col("id") % 3 > 0, degree)
    assert cols == [f"{c}_o{k + 1}" for c in ("x", "two") for k in range(degree)]
    got = out.orderBy("id").toPandas()
    assert got[[f"x_o{k + 1}" for k in range(degree)]].iloc[300].isna().all()
    p = got.iloc[:300][[f"x_o{k + 1}" for k in range(degree)]].to_numpy()
    inside = np.c_[np.full(train.sum(), train.sum() ** -0.5), p[train.to_numpy()]]
    assert np.allclose(inside.T @ inside, np.eye(degree + 1), atol=1e-9)
    # the columns span the powers, for rows outside the training set as well
    z = (pdf.x - pdf.x.mean()) / pdf.x.std()
    powers = np.vander(z, degree + 1, increasing=True)
    fit = np.linalg.lstsq(powers, p, rcond=None)[0]
    assert np.allclose(powers @ fit, p, atol=1e-8) and (fit.diagonal(-1) > 0).all()
    assert got[[f"two_o{k}" for k in range(2, degree + 1)]].isna().all().all() and not got.two_o1.isna().any()
