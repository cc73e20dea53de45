import math

import numpy as np
import pandas as pd
import pytest
from helpers import make_ledger
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strictpast.operators import history
from strictpast.streaming import incremental

WINDOWS = {"10m": 600, "2h": 7200}


def history_input(pdf):
    out = pdf[["from_bank", "from_account", "to_bank", "to_account"]].copy()
    out["sec"] = pdf["ts"].astype("int64") // 10**6
    out["paid"] = pdf["amount_paid"] * 1.5
    out["received"] = pdf["amount_received"] * 0.5
    out["tx"] = np.arange(len(pdf))
    return out


def brute(pdf, windows):
    """Every feature by looking at all earlier rows."""
    rows = list(pdf.itertuples(index=False))
    out = []
    for x in rows:
        s, r = (x.from_bank, x.from_account), (x.to_bank, x.to_account)
        past = [p for p in rows if p.sec < x.sec]
        sent = [p for p in past if (p.from_bank, p.from_account) == s]
        got = [p for p in past if (p.to_bank, p.to_account) == r]
        pair = [p for p in sent if (p.to_bank, p.to_account) == r]

        def firsts(own, side):
            seen, new = set(), []
            for p in sorted(own, key=lambda p: p.sec):
                k = side(p)
                if k not in seen:
                    seen.add(k)
                    new.append(p)
            return new

        new_to, new_from = firsts(sent, lambda p: (p.to_bank, p.to_account)), firsts(got, lambda p: (p.from_bank, p.from_account))
        times = sorted({p.sec for p in sent})
        mean = lambda a: sum(a) / len(a) if a else 0
        ratio = lambda a, b, other: math.log1p(min(a / b, 1e6)) if b > 0 else other
        f = [math.log1p(len(sent)), math.log1p(len(got)), math.log1p(len(pair)), float(not pair), math.log1p(len(new_to)), math.log1p(len(new_from))]
        f.append(mean([p.from_bank != p.to_bank for p in sent]))
        f.append(math.log1p((x.sec - times[-1]) / 60) if times else -1)
        f.append(math.log1p((x.sec - max(p.sec for p in got)) / 60) if got else -1)
        f.append(math.log1p((times[-1] - times[0]) / (len(times) - 1) / 60) if len(times) > 1 else -1)
        f += [ratio(x.paid, mean([p.paid for p in sent]), 0), ratio(x.received, mean([p.received for p in got]), 0)]
        for w in windows.values():
            near = lambda own: [p for p in own if p.sec > x.sec - w]  # noqa: B023, E731
            inflow = sum(p.received for p in past if (p.to_bank, p.to_account) == s and p.sec > x.sec - w)
            paid = sum(p.paid for p in near(sent))
            f += [math.log1p(len(near(sent))), math.log1p(paid), math.log1p(len(near(got))), math.log1p(sum(p.received for p in near(got)))]
            f += [math.log1p(len(near(new_to))), math.log1p(len(near(new_from))), math.log1p(inflow), ratio(paid + x.paid, inflow, -1)]
        out.append(f)
    return np.array(out)


def collected(df, windows=WINDOWS):
    return df.orderBy("tx").toPandas()[history.feature_names(windows)].to_numpy(float)


def test_equals_brute_force(spark):
    pdf = history_input(make_ledger(400, 2, 12, 3))
    found = collected(history.history(spark.createDataFrame(pdf), WINDOWS))
    np.testing.assert_allclose(found, brute(pdf, WINDOWS), rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("span", [7200, 10_000, 86_400])
def test_spans_equal_whole_accounts(spark, span):
    pdf = history_input(make_ledger(400, 3, 8, 13))
    df = spark.createDataFrame(pdf)
    whole = collected(history.history(df, WINDOWS))
    np.testing.assert_allclose(collected(history.history(df, WINDOWS, span=span)), whole, rtol=1e-9)
    cut = int(pdf["sec"].median())
    state = incremental.kept(history.next_state(df.where(F.col("sec") < cut), WINDOWS))
    late = df.where(F.col("sec") >= cut)
    np.testing.assert_allclose(collected(history.history(late, WINDOWS, state, span=span)), collected(history.history(late, WINDOWS, state)), rtol=1e-9)
    with pytest.raises(ValueError):
        history.history(df, WINDOWS, span=60)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_any_batches_equal_one_pass(spark, seed):
    pdf = history_input(make_ledger(300, 2, 12, 5))
    r = np.random.default_rng(seed)
    cuts = sorted({int(x) for x in r.choice(pdf["sec"].unique(), r.integers(1, 5), replace=False)} - {int(pdf["sec"].min())})
    df = spark.createDataFrame(pdf)
    whole = collected(history.history(df, WINDOWS))
    np.testing.assert_allclose(collected(incremental.replay(df, cuts, WINDOWS)), whole, rtol=1e-9)


def test_future_rows_and_order_do_not_matter(spark):
    pdf = history_input(make_ledger(200, 1, 8, 7))
    cut = int(pdf["sec"].quantile(0.6))
    changed = pdf.copy()
    changed.loc[changed["sec"] >= cut, ["paid", "received"]] = 7.0
    changed = changed.sample(frac=1, random_state=1)
    a, b = (collected(history.history(spark.createDataFrame(x), WINDOWS).where(F.col("sec") < cut)) for x in (pdf, changed))
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_window_is_open_at_its_start_and_sums_do_not_cancel(spark):
    rows = [("1", "a", "1", "b", m * 60, p, p, m) for m, p in enumerate([1e20, 1e20, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "from_bank string, from_account string, to_bank string, to_account string, sec long, paid double, received double, tx long")
    found = history.history(df, {"w": 90}).orderBy("tx").toPandas()
    assert found["sender_amount_w_log"].iloc[-1] == pytest.approx(math.log(2))
    exact = history.history(df, {"w": 60}).orderBy("tx").toPandas()
    assert (exact["sender_tx_w_log"] == 0).all()


def test_state_is_bounded_and_late_batches_fail(spark):
    pdf = history_input(make_ledger(400, 3, 12, 9))
    df = spark.createDataFrame(pdf)
    state = history.next_state(df, WINDOWS)
    assert state.recent.agg(F.min("sec")).first()[0] > int(pdf["sec"].max()) - 7200
    with pytest.raises(ValueError):
        history.next_state(df, WINDOWS, state)
    with pytest.raises(ValueError):
        history.history(df, {"w": 0})


def test_stream_equals_one_pass(spark, tmp_path):
    pdf = history_input(make_ledger(240, 2, 10, 11))
    df = spark.createDataFrame(pdf)
    source, out = tmp_path / "in", str(tmp_path / "out")
    cut = int(pdf["sec"].median())
    query = None
    for i, part in enumerate((df.where(F.col("sec") < cut), df.where(F.col("sec") >= cut), df.where(F.col("sec") < cut).limit(5))):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(df.schema).parquet(str(source))
        query = stream.writeStream.foreachBatch(incremental.sink(out, WINDOWS)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    found = spark.read.parquet(f"{out}/features")
    np.testing.assert_allclose(collected(found), collected(history.history(df, WINDOWS)), rtol=1e-9)
    assert spark.read.parquet(f"{out}/late").count() == 5
    again = incremental.sink(out, WINDOWS)
    again(df, 0)  # a batch already taken
    assert spark.read.parquet(f"{out}/features").count() == len(pdf)


def test_extra_columns_pass_through(spark):
    pdf = history_input(make_ledger(50, 1, 5, 2)).assign(note="x")
    found = history.history(spark.createDataFrame(pdf), WINDOWS, names=["sender_prev_tx_log"])
    assert found.columns == [*pdf.columns, "sender_prev_tx_log"]
    assert isinstance(found.toPandas(), pd.DataFrame)


def test_one_pair_of_half_of_all_rows(spark, monkeypatch):
    """A hot pair and its accounts are cut into spans without being asked to, and nothing changes."""
    pdf = history_input(make_ledger(400, 6, 12, 3))
    hot = np.arange(len(pdf)) % 2 == 0
    for column in history.PAIR:
        pdf.loc[hot, column] = pdf[column].iloc[0]
    df = spark.createDataFrame(pdf)
    assert history.busy_span(df, WINDOWS) is None
    whole = collected(history.history(df, WINDOWS))
    np.testing.assert_allclose(whole, brute(pdf, WINDOWS), rtol=1e-5, atol=1e-5)
    span = history.busy_span(df, WINDOWS, 100)
    assert max(WINDOWS.values()) <= span < int(pdf["sec"].max() - pdf["sec"].min())
    monkeypatch.setattr(history, "busy_span", lambda rows, windows: span)
    np.testing.assert_allclose(collected(history.history(df, WINDOWS)), whole, rtol=1e-9)


def test_a_failed_commit_leaves_the_state_before(spark, tmp_path, monkeypatch):
    pdf = history_input(make_ledger(300, 3, 10, 15))
    df = spark.createDataFrame(pdf)
    cuts = [int(x) for x in pdf["sec"].quantile([0.25, 0.5, 0.75])]
    parts = [df.where((F.col("sec") >= lo) & (F.col("sec") < hi)) for lo, hi in zip([0, *cuts], [*cuts, 1 << 40])]
    out = str(tmp_path / "out")
    take = incremental.sink(out, WINDOWS)
    take(parts[0], 0)
    before = incremental.load_state(spark, f"{out}/state")
    with monkeypatch.context() as m:
        m.setattr(incremental.Files, "replace", lambda *a: 1 / 0)  # between the write and the rename
        with pytest.raises(ZeroDivisionError):
            take(parts[1], 1)
    after = incremental.load_state(spark, f"{out}/state")
    assert before[1] == after[1] == 0 and before[0].last == after[0].last
    for i in (1, 2, 3):
        take(parts[i], i)
    found = spark.read.parquet(f"{out}/features")
    np.testing.assert_allclose(collected(found), collected(history.history(df, WINDOWS)), rtol=1e-9)
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir() if p.is_dir()) == ["v2", "v3"]
