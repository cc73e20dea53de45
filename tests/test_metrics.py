import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strictpast.functions import running
from strictpast.functions.quantiles import quantiles
from strictpast.operators import drift, learners, metrics, periods


def scored(seed=0, n=600, levels=40):
    r = np.random.default_rng(seed)
    s = r.integers(0, levels, n) / levels
    y = (r.random(n) < 0.1 + 0.5 * s).astype(int)
    return pd.DataFrame({"id": np.arange(n), "score": s, "target": y})


def step_ap(y, s):
    out, hits, seen, last = 0.0, 0, 0, 0.0
    for v in sorted(set(s), reverse=True):
        m = s == v
        hits, seen = hits + y[m].sum(), seen + m.sum()
        out += (hits / y.sum() - last) * hits / seen
        last = hits / y.sum()
    return out


def test_ranking_metrics(spark):
    pdf = scored()
    curve = metrics.score_curve(spark.createDataFrame(pdf))
    y, s = pdf["target"].to_numpy(), pdf["score"].to_numpy()
    assert metrics.average_precision(curve).first()[0] == pytest.approx(step_ap(y, s))
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert metrics.roc_auc(curve).first()[0] == pytest.approx(auc)
    best = metrics.best_threshold(curve).first()
    f1 = {t: 2 * (y & (s >= t)).sum() / (y.sum() + (s >= t).sum()) for t in set(s)}
    assert best["f1"] == pytest.approx(max(f1.values())) and best["threshold"] == min(t for t in f1 if f1[t] == pytest.approx(max(f1.values())))


def test_undefined_metrics_are_null(spark):
    curve = metrics.score_curve(spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, target int"))
    assert metrics.average_precision(curve).first()[0] is None and metrics.roc_auc(curve).first()[0] is None
    row = metrics.error_summary(spark.createDataFrame([(0, False)], "target int, prediction boolean")).first()
    assert row["precision"] is None and row["recall"] is None and row["alert_rate"] == 0
    with pytest.raises(ValueError):
        metrics.check_scores(spark.createDataFrame([(float("nan"),)], "score double"))


def test_daily_budget(spark):
    pdf = scored(3, 100)
    df = spark.createDataFrame(pdf).withColumn("ts", F.expr("timestampadd(HOUR, cast(id % 72 as int), timestamp_ntz'2025-01-01 00:00:00')"))
    out = metrics.daily_alerts(df, 0.1, ["id"]).toPandas()
    for _, g in out.groupby(out["ts"].dt.date):
        k = math.floor(len(g) * 0.1)
        expected = g.sort_values(["score", "id"], ascending=[False, True]).head(k)["id"]
        assert set(g[g["prediction"]]["id"]) == set(expected)
    with pytest.raises(ValueError):
        metrics.daily_alerts(df, 0, ["id"])


def test_mid_ranks_and_calibration(spark):
    pdf = scored(5, 200, 15)
    ranks = metrics.mid_ranks(spark.createDataFrame(pdf), ["score"]).orderBy("id").toPandas()["score_rank"]
    np.testing.assert_allclose(ranks, pdf["score"].rank().to_numpy())
    bins = metrics.calibration(spark.createDataFrame(pdf)).toPandas()
    assert bins["rows"].sum() == 200 and (bins["observed"] <= 1).all()


def psi(a, b, bins=10):
    """From the definition, bin by bin."""
    x = a[~np.isnan(a)]
    edges = sorted(set(np.quantile(x, np.linspace(0, 1, bins + 1)))) if len(x) else []
    if len(edges) < 2:
        c = edges[0] if edges else 0.0
        edges = [np.nextafter(c, -np.inf), np.nextafter(c, np.inf)]
    count = lambda v: np.array([np.isnan(v).sum()] + [sum((np.searchsorted(edges, v[~np.isnan(v)], side="right") == i)) for i in range(len(edges) + 1)]) + 0.5
    p, q = count(a) / count(a).sum(), count(b) / count(b).sum()
    return ((q - p) * np.log(q / p)).sum()


def test_drift(spark):
    r = np.random.default_rng(1)
    a = pd.DataFrame({"x": r.normal(size=300), "flat": np.ones(300), "few": r.integers(0, 3, 300).astype(float), "gone": np.nan})
    b = pd.DataFrame({"x": r.normal(0.5, 1, 200), "flat": np.r_[np.ones(150), np.zeros(50)], "few": r.integers(0, 3, 200).astype(float), "gone": np.nan})
    a.loc[:20, "x"] = np.nan
    report = drift.drift_report(spark.createDataFrame(a), spark.createDataFrame(b), list(a.columns)).toPandas().set_index("feature")
    for c in a.columns:
        assert report.loc[c, "psi"] == pytest.approx(psi(a[c].to_numpy(), b[c].to_numpy()), abs=1e-9), c
    assert report.loc["x", "missing_reference"] == pytest.approx(21 / 300) and report.loc["flat", "investigate"]


def test_folds(spark):
    day = 86400
    folds = periods.rolling_folds(100, 9 * day)
    assert folds[0] == (0, "train", 100, 3 * day) and folds[-1] == (2, "evaluation", 6 * day, 7 * day)
    for bad in (dict(n_folds=0), dict(initial_days=30)):
        with pytest.raises(ValueError):
            periods.rolling_folds(100, 9 * day, **bad)


def test_learners(spark):
    pdf = scored(7, 400).rename(columns={"target": "label", "score": "x"}).assign(sample_weight=1.0, z=1.0)
    df = spark.createDataFrame(pdf)
    best, log = learners.search(learners.logistic, df, df, ["x", "z"], {"c": [0.01, 1.0]}, trials=2)
    assert len(log) == 2 and best(df).count() == 400
    name, values = learners.champion({"lr": best, "gbt": learners.boosted(df, ["x", "z"], rounds=3)}, df)
    assert name in values and all(0 < v <= 1 for v in values.values())
    both = spark.createDataFrame(scored(8, 300).assign(two=lambda d: 1 - d["score"]))
    row = learners.bootstrap_difference(both, "score", "two", 40).first()
    assert row["low"] <= row["mean"] <= row["high"] and row["share_better"] == 1.0


def test_quantiles_are_equal_either_way(spark):
    r = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], float(np.round(x, 1))) for i, x in enumerate(r.normal(size=700))] + [("a", None), ("c", None), ("d", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    for groups in (["g"], []):
        one, two = ({x["g"] if groups else 0: (x["q"], x["n"]) for x in quantiles(df, groups, "x", shares, most).collect()} for most in (10**6, 10))
        assert one.keys() == two.keys() and "c" not in one
        for g, (q, n) in one.items():
            values = [x for k, x in rows if x is not None and (not groups or k == g)]
            assert n == two[g][1] == len(values)
            np.testing.assert_allclose(q, np.quantile(values, shares))
            np.testing.assert_allclose(two[g][0], q)
    assert quantiles(df.limit(0), [], "x", [0.5]).count() == 0


def test_running_sums_over_many_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("n"))
    for descending in (False, True):
        found = running.running_sums(df, "v", ["n"], descending, parts=13).collect()
        assert len(found) == 1000 and all(r["run_n"] == (1000 - r["v"] if descending else r["v"] + 1) for r in found)


def test_folds_hold_rows(spark):
    day = 86400
    df = spark.createDataFrame([(d * day + 100,) for d in (0, 1, 2, 3, 4, 6, 7, 8)], "sec long").select(F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"))
    assert len(periods.planned_folds(df.where("ts < '1970-01-06'"), 1, 2, 1, 1)) == 3
    with pytest.raises(ValueError, match="val of fold 2"):
        periods.planned_folds(df, 3, 3, 1, 1)
    with pytest.raises(ValueError):
        periods.planned_folds(df.limit(0))


def test_resamples_against_brute_force(spark, monkeypatch):
    pdf = scored(3, 400, 25)
    df = spark.createDataFrame(pdf).withColumn("row", F.col("id"))
    weights = learners.draws(pdf["id"].to_numpy(), np.arange(20), 5)
    assert abs(weights.mean() - 1) < 0.05 and abs(weights.var() - 1) < 0.1

    def weighted(w):
        out, hits, seen = 0.0, 0.0, 0.0
        for v in sorted(set(pdf["score"]), reverse=True):
            m = (pdf["score"] == v).to_numpy()
            pos = (w * pdf["target"])[m].sum()
            hits, seen = hits + pos, seen + w[m].sum()
            out += pos * hits / max(seen, 1)
        return out / (w * pdf["target"]).sum()

    expected = [weighted(weights[:, r]) for r in range(20)]
    for rows in (1000, 60):
        monkeypatch.setattr(learners, "BOOTSTRAP_ROWS", rows)
        found = {r.replicate: r.precision for r in learners._resampled_precision(df, "score", 20, 5).collect()}
        np.testing.assert_allclose([found[r] for r in range(20)], expected)
    same = learners.bootstrap_difference(df.withColumn("other", F.col("score")), "score", "other", 10).first()
    assert same["mean"] == same["low"] == same["high"] == same["share_better"] == 0
    assert learners.bootstrap_difference(df.withColumn("target", F.lit(0)).withColumn("other", F.lit(1.0)), "score", "other", 5).first()["mean"] is None


def test_search_closes_in_and_goes_on(monkeypatch):
    grid = {"a": list(range(7)), "b": [0.1, 0.2, 0.4, 0.8]}
    asked = []

    def fit(train, features, a, b):
        asked.append((a, b))
        return lambda df: 1 - abs(a - 5) / 10 - abs(b - 0.4)

    monkeypatch.setattr(learners, "average_precision_of", lambda x: x)
    scorer, log = learners.search(fit, None, None, [], grid, 16, 3)
    assert len(log) == len(set(asked)) == 16
    first = log[:8]
    centre = max(first, key=lambda x: x["average_precision"])
    steps = lambda x, y: abs(x["a"] - y["a"]) + abs(grid["b"].index(x["b"]) - grid["b"].index(y["b"]))
    untried = [{"a": a, "b": b} for a in grid["a"] for b in grid["b"] if {"a": a, "b": b} not in [{k: x[k] for k in "ab"} for x in first]]
    assert steps(log[8], centre) == min(steps(x, centre) for x in untried)
    assert scorer(None) == max(x["average_precision"] for x in log) == 1
    asked.clear()
    again, whole = learners.search(fit, None, None, [], grid, 16, 3, log[:11])
    assert whole == log and asked[:5] == [(x["a"], x["b"]) for x in log[11:]] and again(None) == scorer(None)
