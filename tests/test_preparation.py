import json
import math
import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import make_ledger, to_spark
from pyspark.sql import functions as F

from strictpast import cli, schema
from strictpast.operators import currency, encoding, history, learners, periods, sampling, validate
from strictpast.operators.history import next_state
from strictpast.plans import pipeline, storage
from strictpast.sources import ledger as sources
from strictpast.sources import runs
from strictpast.sources.files import Files

RAW = {v: k for k, v in schema.RAW_TO_OWN.items()}


def write_csv(pdf, path, order=None, bom=False, fmt="%Y/%m/%d %H:%M"):
    out = pdf.rename(columns=RAW).copy()
    out["Timestamp"] = out["Timestamp"].dt.strftime(fmt)
    out = out[order or list(schema.RAW_TO_OWN)]
    text = out.to_csv(index=False)
    head, body = text.split("\n", 1)
    head = head.replace("Account.1", "Account")
    path.write_text(("﻿" if bom else "") + head + "\n" + body)


def test_csv_and_parquet_agree(spark, tmp_path):
    pdf = make_ledger(300)
    write_csv(pdf, tmp_path / "a.csv", bom=True)
    pdf.rename(columns=RAW).to_parquet(tmp_path / "a.parquet")
    a, pa = sources.extract(spark, str(tmp_path / "a.csv"))
    b, pb = sources.extract(spark, str(tmp_path / "a.parquet"))
    assert a.schema == b.schema
    assert a.exceptAll(b).count() == 0 and pa.extracted_rows == pb.extracted_rows == 300
    assert pa.sha256 == sources.sha256_of(str(tmp_path / "a.csv"), 7)
    assert a.first()["from_account"].startswith("0")


@pytest.mark.parametrize("break_it", ["column", "time", "suffix", "absent", "chunk"])
def test_sources_reject(spark, tmp_path, break_it):
    pdf = make_ledger(50)
    path = tmp_path / "a.csv"
    write_csv(pdf, path, fmt="%d.%m.%Y" if break_it == "time" else "%Y/%m/%d %H:%M")
    if break_it == "column":
        path.write_text(path.read_text().replace("Payment Format", "Format"))
    if break_it == "chunk":
        with pytest.raises(ValueError):
            sources.sha256_of(str(path), 0)
        return
    if break_it == "suffix":
        path = path.rename(tmp_path / "a.txt")
    if break_it == "absent":
        path.unlink()
    with pytest.raises((ValueError, FileNotFoundError)):
        sources.extract(spark, str(path))


def test_iso_times_and_any_column_order(spark, tmp_path):
    pdf = make_ledger(40)
    write_csv(pdf, tmp_path / "a.csv", fmt="%Y-%m-%dT%H:%M:%S")
    assert sources.extract(spark, str(tmp_path / "a.csv"))[0].agg(F.min("ts")).first()[0] == pdf["ts"].min().to_pydatetime()


def test_sender_sampling_keeps_whole_histories(spark):
    df = to_spark(spark, make_ledger(2000, accounts=400))
    some = sampling.sample_senders(df, 5)
    assert sampling.sample_senders(some, 5).count() == some.count()
    kept = {r[0] for r in some.select("from_account").distinct().collect()}
    assert some.count() == df.where(F.col("from_account").isin(list(kept))).count()
    assert 30 < len(kept) < 130


@pytest.mark.parametrize("column,value", [("payment_format", "Telegraph"), ("from_account", ""), ("amount_paid", -1.0), ("amount_paid", float("nan")), ("label", 2), ("to_account", None)])
def test_gates(spark, column, value):
    pdf = make_ledger(60)
    df = to_spark(spark, pdf).withColumn("n", F.monotonically_increasing_id())
    kind = df.schema[column].dataType
    df = df.withColumn(column, F.when(F.col("n") == F.lit(df.agg(F.min("n")).first()[0]), F.lit(value).cast(kind)).otherwise(F.col(column))).drop("n")
    with pytest.raises(ValueError):
        validate.validate_ledger(df)


def test_valid_ledger_passes_and_keeps_duplicates(spark):
    pdf = pd.concat([make_ledger(60), make_ledger(60)])
    df = to_spark(spark, pdf)
    assert validate.validate_ledger(df.withColumn("extra", F.lit(1))).columns == list(schema.COLUMNS)
    assert validate.validate_ledger(df).count() == 120
    assert validate.duplicate_rows(df, list(schema.COLUMNS)).first()[0] == 60
    with pytest.raises(ValueError):
        validate.validate_ledger(df.limit(0))
    with pytest.raises(ValueError):
        validate.validate_ledger(df.drop("label"))


def test_calendar_example(spark):
    start = datetime(2025, 1, 1)
    rows = [start + timedelta(days=d, hours=h) for d in range(10) for h in range(24) for _ in range(10)]
    rows += [datetime(2025, 1, 11 + i) for i in range(3)]
    df = spark.createDataFrame([(t, 1) for t in rows], "ts timestamp_ntz, label int")
    starts = periods.fit_periods(df, periods.SplitConfig(test_size=0.2))
    day = lambda s: datetime(1970, 1, 1) + timedelta(seconds=s)
    assert [day(starts[p]).day for p in periods.PERIODS] == [1, 2, 7, 8, 9, 11]
    report = {r["period"]: r["rows"] for r in periods.period_report(df, starts).collect()}
    assert report["tail"] == 3 and report["warmup"] == 240 and sum(report.values()) == 2403
    whole = periods.fit_periods(df, periods.SplitConfig(test_size=0.2, tail_min_share=None))
    assert "tail" not in whole


def test_period_errors():
    with pytest.raises(ValueError):
        periods.plan_periods([(0, 5, 0), (86400, 5, 86400)])
    with pytest.raises(ValueError):
        periods.period_of({"warmup": 5, "train": 1}, F.lit(1))
    with pytest.raises(ValueError):
        periods.SplitConfig(test_size=0)
    with pytest.raises(ValueError):
        periods.check_periods({"train": (3, 1, 9), "val": (1, 9, 9), "threshold": (1, 10, 10), "test": (1, 11, 11)})


def test_rates_are_recovered_and_gaps_reported(spark):
    df = to_spark(spark, make_ledger(2000))
    rates = currency.fit_rates(df)
    assert currency.rate_of(rates, "Euro") == pytest.approx(1.1, rel=1e-2) and rates.max_abs_log_residual < 1e-2
    alone = df.limit(1).withColumns({"payment_currency": F.lit("Yen"), "receiving_currency": F.lit("Yen")})
    with pytest.raises(ValueError):
        currency.fit_rates(df.unionByName(alone))
    with pytest.raises(ValueError):
        currency.to_anchor(alone, rates)
    with pytest.raises(ValueError):
        currency.fit_rates(df, "Peso")


def golden(spark, flip=False):
    y = [0, 1, 1, 0] if flip else [0, 1, 0, 1]
    rows = [("a", i + 1, datetime(2025, 1, 1 + i // 2), y[i], w) for i, w in enumerate((9, 1, 9, 1))]
    return spark.createDataFrame(rows, "kind string, amount int, ts timestamp_ntz, label int, w int")


def test_encoder_example(spark):
    config = encoding.EncoderConfig(("kind",), (), (2.0,))
    for flip in (False, True):
        out = encoding.encode_training(golden(spark, flip), config, weight="w").orderBy("amount").toPandas()
        assert out["kind__ote_2"].tolist() == pytest.approx([0, 0, 0.1, 0.1])
        assert list(out.columns) == ["amount", "ts", "label", "w", "kind__ote_2", "kind__hist_log_count"]
    model = encoding.fit_encoder(golden(spark), config, weight="w")
    new = encoding.encode_frozen(spark.createDataFrame([("new", 5), (None, 6)], "kind string, amount int"), model).toPandas()
    assert new["kind__ote_2"].tolist() == pytest.approx([0.1, 0.1]) and (new["kind__hist_log_count"] == 0).all()


def test_encoder_errors(spark):
    with pytest.raises(ValueError):
        encoding.EncoderConfig(("a",), (), (0.0,))
    with pytest.raises(ValueError):
        encoding.EncoderConfig(("a",), initial_prior=2)
    with pytest.raises(ValueError):
        encoding.fit_encoder(golden(spark).withColumn("label", F.lit(3)), encoding.EncoderConfig(("kind",)))
    with pytest.raises(ValueError):
        encoding.fit_encoder(golden(spark).withColumn("w", F.lit(-1.0)), encoding.EncoderConfig(("kind",)), weight="w")


def test_downsampling_is_exact(spark):
    df = to_spark(spark, make_ledger(800))
    for key in (F.xxhash64("ts", "from_account"), F.lit(3)):
        out = sampling.downsample_negatives(df, 0.3, key)
        n = df.where("label = 0").count()
        assert out.where("label = 0").count() == int(0.3 * n) and out.where("label = 1").count() == 800 - n
        assert out.agg(F.sum("sample_weight")).first()[0] == pytest.approx(800)


def test_run_round_trip(spark, tmp_path, monkeypatch):
    pdf = make_ledger(2500, 12, 200)
    path, parent = tmp_path / "ledger.csv", str(tmp_path / "runs")
    write_csv(pdf, path)
    run = pipeline.prepare(spark, str(path), parent)
    assert runs.resolve_run(spark, parent) == run == runs.resolve_etl_run(spark, parent)
    found = runs.manifest(spark, run)
    assert sum(found["rows"].values()) + sum(found["excluded_rows"].values()) == 2500
    splits = runs.load_splits(spark, run)
    x, y = splits["train"]
    assert len(x.columns) == 74 and x.count() == y.count() == found["rows"]["train"]
    assert set(runs.load_splits(spark, run, "all")) == set(pipeline.MODEL_PERIODS)
    assert runs.load_times(spark, run, "val").count() == found["rows"]["val"]
    bad = x.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in x.columns]).first()
    assert not any(bad)
    for name in ("../train", "", ".hidden"):
        with pytest.raises(ValueError):
            runs.load_splits(spark, run, [name])
    assert runs.load_run_raw(spark, run).count() == 2500
    frozen = encoding.encode_frozen(to_spark(spark, pdf.head(50)), runs.load_encoder(spark, run))
    assert frozen.count() == 50 and runs.load_rates(spark, run).log_rates["US Dollar"] == 0
    with pytest.raises(FileNotFoundError):
        runs.resolve_training(spark, run)
    folder = runs.publish_training(spark, run, "lr", {"lr": 0.5}, x.columns, [{"c": 1.0, "average_precision": 0.5}])
    assert runs.resolve_training(spark, run) == folder
    pointer = (tmp_path / "runs" / "active.json").read_text()
    monkeypatch.setattr(runs, "save_encoder", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pipeline.prepare(spark, str(path), parent)
    assert (tmp_path / "runs" / "active.json").read_text() == pointer
    path.write_text(path.read_text() + "\n")
    with pytest.raises(ValueError):
        runs.load_run_raw(spark, run)
    other = runs.publish_encoded(spark, parent, run, {"train": x}, {})
    assert runs.resolve_run(spark, parent) == other and runs.resolve_etl_run(spark, parent) == run


def test_strict_json(spark, tmp_path):
    with pytest.raises(ValueError):
        Files(spark).write_json(str(tmp_path / "a.json"), {"x": math.nan})
    Files(spark).write_json(str(tmp_path / "b.json"), {"x": "é"})
    assert json.loads((tmp_path / "b.json").read_text()) == {"x": "é"}


def test_sequential_equals_one_pass_and_labels_do_not_leak(spark):
    pdf = make_ledger(1200, 12, 60)
    config = pipeline.EtlConfig()
    ledger = to_spark(spark, pdf)
    result = pipeline.transform(ledger, config)
    starts = result.metadata["periods"]
    flipped = pdf.copy()
    late = pdf["ts"].astype("int64") // 10**6 >= starts["val"]
    flipped.loc[late, "label"] = 1 - flipped.loc[late, "label"]
    other = pipeline.transform(to_spark(spark, flipped), config)
    key = ["ts", *result.feature_names]
    a, b = (x.features.select(*key).toPandas().sort_values(key).reset_index(drop=True) for x in (result, other))
    pd.testing.assert_frame_equal(a, b)
    # The test period scored as a later batch has the features of the single pass.
    test_start = datetime(1970, 1, 1) + timedelta(seconds=starts["test"])
    before = ledger.where(F.col("ts") < F.lit(test_start).cast("timestamp_ntz"))
    state = next_state(pipeline.history_rows(before, result.rates))
    scored = pipeline.score_later(ledger.where(F.col("ts") >= F.lit(test_start).cast("timestamp_ntz")), result, state).toPandas().sort_values(key).reset_index(drop=True)
    whole = result.features.where("period = 'test'").select(*key).toPandas().sort_values(key).reset_index(drop=True)
    np.testing.assert_allclose(scored[result.feature_names].to_numpy(float), whole[result.feature_names].to_numpy(float), rtol=1e-5, atol=1e-5)


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, psi double")
    runs.write_report(df, str(tmp_path / "drift"), by="psi")
    assert spark.read.option("header", True).csv(str(tmp_path / "drift.csv")).count() == 2
    assert "<table" in (tmp_path / "drift.html").read_text()


def test_a_run_scores_later_batches_from_disk(spark, tmp_path):
    pdf = make_ledger(2500, 14, 120)
    cut = pdf["ts"].quantile(0.85).normalize()
    old, new = pdf[pdf["ts"] < cut], pdf[pdf["ts"] >= cut]
    write_csv(old, tmp_path / "old.csv")
    run = pipeline.prepare(spark, str(tmp_path / "old.csv"), str(tmp_path / "runs"))
    scorer = runs.load_scorer(spark, run)
    later = to_spark(spark, new)
    found = scorer(later).toPandas()
    rates = runs.load_rates(spark, run)
    whole = pipeline.featured(to_spark(spark, pdf), rates, scorer.windows)
    names = history.feature_names(scorer.windows)
    expected = whole.where(F.col("ts") >= F.lit(cut.to_pydatetime()).cast("timestamp_ntz")).select("ts", *names).toPandas()
    assert len(found) == len(new) and list(found.columns) == ["ts", *runs.manifest(spark, run)["feature_schema"]]
    key = ["ts", *names]
    a, b = (x[key].sort_values(key).reset_index(drop=True) for x in (found, expected))
    np.testing.assert_allclose(a[names].to_numpy(float), b[names].to_numpy(float), rtol=1e-5, atol=1e-5)
    half = new["ts"].median()
    one, two = to_spark(spark, new[new["ts"] <= half]), to_spark(spark, new[new["ts"] > half])
    apart = pd.concat([scorer(one).toPandas(), scorer.after(one)(two).toPandas()])[key].sort_values(key).reset_index(drop=True)
    np.testing.assert_allclose(apart[names].to_numpy(float), b[names].to_numpy(float), rtol=1e-5, atol=1e-5)
    quality = runs.manifest(spark, run)["quality"]
    assert quality["rows"] == len(old) and quality["positives"] == int(old["label"].sum()) and quality["duplicate_rows"] == int(old.duplicated().sum())
    rows, times = runs.load_rows(spark, run, "val"), runs.load_times(spark, run, "val")
    assert rows.join(times, "row_id").count() == rows.count() == times.count()
    with pytest.raises(FileNotFoundError):
        runs.load_splits(spark, run, "later")


def test_champion_is_loaded_as_saved(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a + 0.3 * b > 0.6), 1.0) for a, b in r.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label int, sample_weight double")
    train, val = df.limit(300), df.subtract(df.limit(300))
    run = runs.new_run(spark, str(tmp_path))
    for name, fit in (("lr", learners.logistic), ("gbt", lambda t, f: learners.boosted(t, f, rounds=12, depth=2, val=val))):
        scorer = fit(train, ["a", "b"])
        runs.publish_training(spark, run, name, {name: 0.5}, ["a", "b"], [{"c": 1.0}], scorer)
        again, bundle = runs.load_champion(spark, run)
        assert bundle["name"] == name and bundle["importances"]["a"] > bundle["importances"]["b"]
        x, y = (np.sort([q.score for q in m(val).collect()]) for m in (scorer, again))
        np.testing.assert_allclose(x, y)
    assert len(again.model.stages[-1].trees) <= 12


def test_command_line(spark, tmp_path, capsys):
    write_csv(make_ledger(2500, 12, 200), tmp_path / "a.csv")
    run = cli.main(["--source", str(tmp_path / "a.csv"), "--output", str(tmp_path / "runs"), "--warmup-days", "2", "--keep-sparse-tail"])
    found = runs.manifest(spark, run)["configuration"]["split"]
    assert capsys.readouterr().out.strip().endswith(run) and found["warmup_units"] == 2 and found["tail_min_share"] is None
    assert cli.split_of({"warmup_days": None, "keep_sparse_tail": False}) == periods.SplitConfig()
    for bad in ([], ["--source", "x", "--warmup-days", "two"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_encoding_checks_its_rows_when_asked(spark):
    config = encoding.EncoderConfig(("kind",), (), (2.0,))
    for column, value in (("label", 3), ("w", -1.0)):
        with pytest.raises(ValueError):
            encoding.encode_training(golden(spark).withColumn(column, F.lit(value)), config, weight="w", check=True)


def test_encoding_shares_one_grid(spark):
    df = to_spark(spark, make_ledger(300))
    config = encoding.EncoderConfig(("payment_format", "payment_currency"), (("from_bank", "from_account"), ("from_bank", "to_bank")))
    plan = encoding.encode_training(df, config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 15 and "Python" not in plan


def test_large_files_are_digested_as_streams(spark, tmp_path, monkeypatch):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text("x" * (i + 1))
    whole = sources.source_digest(spark, str(folder))
    monkeypatch.setattr(sources, "WHOLE", 2)
    assert sources.source_digest(spark, str(folder)) == whole


def test_reports_are_whole_or_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "REPORT_ROWS", 5)
    runs.write_report(spark.range(5).toDF("n"), str(tmp_path / "a"), by="n")
    assert (tmp_path / "a.html").read_text().count("<tr>") == 5
    with pytest.raises(ValueError):
        runs.write_report(spark.range(6).toDF("n"), str(tmp_path / "b"))
    assert not (tmp_path / "b.csv").exists()


def test_scratch_tables_go(spark, tmp_path):
    with storage.scratch():
        kept = storage.materialised(spark.range(5), "kept")
        folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)
