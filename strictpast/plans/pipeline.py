"""The whole preparation as one lazy plan: periods, rates, history, row-wise features, encoding."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.functions.expressions import basic_features, epoch_seconds, floored
from strictpast.operators import currency, encoding, history, periods, validate
from strictpast.plans.storage import materialised, scratch
from strictpast.schema import ANCHOR_CURRENCY, IDENTIFIERS

MODEL_PERIODS = ("train", "val", "threshold", "test")
FLOAT_FLAGS = {"is_new_pair", "hour", "is_night", "is_currency_same", "is_same_bank", "is_self_transfer", "is_round_10", "is_round_100", "is_round_1000"}


@dataclass(frozen=True)
class EtlConfig:
    split: periods.SplitConfig = periods.SplitConfig()
    windows: dict[str, int] = field(default_factory=lambda: dict(history.WINDOWS))
    anchor: str = ANCHOR_CURRENCY
    smoothing: tuple[float, ...] = (20.0, 200.0)
    interactions: tuple[tuple[str, ...], ...] = (("from_bank", "from_account"), ("to_bank", "to_account"), ("from_bank", "to_bank"), ("receiving_currency", "payment_currency"))

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class TransformResult:
    """``features``: period, ts, label and the feature columns of the four model periods."""

    features: DataFrame
    rates: currency.Rates
    encoder: encoding.EncoderModel
    feature_names: list[str]
    feature_schema: dict[str, str]
    metadata: dict


def featured(ledger: DataFrame, rates: currency.Rates, windows: dict[str, int], state: history.State | None = None) -> DataFrame:
    """``ledger`` with USD amounts, the 13 row-wise columns and the history columns, as they are stored."""
    rows = currency.to_anchor(ledger, rates, check=state is not None).withColumn("sec", epoch_seconds("ts"))
    rows = rows.withColumns({"paid": floored(F.col("amount_paid_usd")), "received": floored(F.col("amount_received_usd"))})
    made = history.history(rows.withColumns(basic_features()), windows, state)
    names = [*basic_features(), *history.feature_names(windows)]
    kept = [c for c in made.columns if c not in names and c not in ("paid", "received", "amount_paid_usd", "amount_received_usd")]
    return made.select(*kept, *[F.col(n).cast("byte" if n in FLOAT_FLAGS else "float").alias(n) for n in names])


def transform(ledger: DataFrame, config: EtlConfig = EtlConfig()) -> TransformResult:
    """Features of a validated ledger. Three small results come to the driver: the unit histogram, currency medians, the prior.

    Tail rows are dropped before the windows, which they can't change; warmup rows only after, since they are history.
    """
    starts = periods.fit_periods(ledger, config.split)
    sec = epoch_seconds("ts")
    named = ledger.withColumn("period", periods.period_of(starts, sec))
    report = {r["period"]: r for r in periods.period_report(ledger, starts).collect()}
    periods.check_periods({k: (r["rows"], r["min_ts"], r["max_ts"]) for k, r in report.items()})
    rates = currency.fit_rates(named.where(F.col("period").isin("warmup", "train")), config.anchor)
    rows = featured(named.where(F.col("period") != "tail"), rates, config.windows).where(F.col("period") != "warmup")
    known = list(rates.log_rates)
    unknown = named.where(F.col("period") != "tail").select(F.explode(F.array("payment_currency", "receiving_currency")).alias("c")).where(~F.col("c").isin(known)).distinct().limit(20).collect()
    if unknown:
        raise ValueError(f"no exchange rate for: {sorted(r[0] for r in unknown)}")
    encoder_config = encoding.EncoderConfig(IDENTIFIERS, config.interactions, config.smoothing)
    train = rows.where(F.col("period") == "train")
    model = encoding.fit_encoder(train, encoder_config)
    both = encoding.encode_training(train, encoder_config).unionByName(encoding.encode_frozen(rows.where(F.col("period") != "train"), model))
    encoded = [c for c in both.columns if "__ote_" in c or c.endswith("__hist_log_count")]
    names = [*basic_features(), *history.feature_names(config.windows), *encoded]
    out = both.select("period", "ts", "label", *[F.col(c).cast("float").alias(c) if c in encoded else F.col(c) for c in names])
    schema = {c: t for c, t in out.dtypes if c in set(names)}
    metadata = {
        "periods": starts,
        "period_report": {k: {"rows": r["rows"], "positives": r["positives"], "min": r["min_ts"].isoformat(), "max": r["max_ts"].isoformat()} for k, r in report.items()},
        "excluded_rows": {k: report[k]["rows"] if k in report else 0 for k in ("warmup", "tail")},
        "rates": rates.report(),
        "label_availability": "labels count as known at the time of their row",
    }
    return TransformResult(out, rates, model, names, schema, metadata)


@dataclass
class Scorer:
    """What it takes to score batches after the training data."""

    rates: currency.Rates
    encoder: encoding.EncoderModel
    feature_schema: dict[str, str]
    state: history.State
    windows: dict[str, int]

    def __call__(self, ledger: DataFrame) -> DataFrame:
        return score_later(ledger, self, self.state, self.windows)

    def after(self, ledger: DataFrame) -> Scorer:
        """The scorer of the batch that follows ``ledger``."""
        return replace(self, state=history.next_state(history_rows(ledger, self.rates), self.windows, self.state))


def score_later(ledger: DataFrame, result: TransformResult | Scorer, state: history.State, windows: dict[str, int] = history.WINDOWS) -> DataFrame:
    """Features of a batch after the training data, with frozen rates and statistics and the history in ``state``."""
    rows = featured(ledger, result.rates, windows, state)
    out = encoding.encode_frozen(rows, result.encoder)
    return out.select("ts", *[F.col(n).cast(t).alias(n) for n, t in result.feature_schema.items()])


def history_rows(ledger: DataFrame, rates: currency.Rates) -> DataFrame:
    """What the history state is made of."""
    rows = currency.to_anchor(ledger, rates, check=False).withColumn("sec", epoch_seconds("ts"))
    return rows.withColumns({"paid": floored(F.col("amount_paid_usd")), "received": floored(F.col("amount_received_usd"))})


def prepare(spark, source: str, parent: str, sample: bool = False, config: EtlConfig = EtlConfig()) -> str:
    """Read, validate, report on, transform and publish; returns the run's folder."""
    from strictpast.sources.ledger import extract
    from strictpast.sources.runs import publish

    with scratch():
        raw, provenance = extract(spark, source, sample)
        ledger = materialised(validate.validate_ledger(raw), "ledger")
        report = validate.quality_report(ledger).first().asDict() | validate.duplicate_rows(ledger, ledger.columns).first().asDict()
        quality = {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in report.items()}
        result = transform(ledger, config)
        kept = ledger.where(periods.period_of(result.metadata["periods"], epoch_seconds("ts")) != "tail")
        state = history.next_state(history_rows(kept, result.rates), config.windows)
        return publish(result, parent, provenance, {"sample": sample, **config.to_dict()}, state, quality)
