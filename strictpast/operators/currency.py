"""Exchange rates inferred from cross-currency payments."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.functions.quantiles import quantiles
from strictpast.plans.storage import materialised
from strictpast.schema import ANCHOR_CURRENCY


def pair_medians(df: DataFrame, paid: str = "amount_paid", received: str = "amount_received") -> DataFrame:
    """(pay, receive, median, n): the median log ratio of each ordered pair of different currencies."""
    p, r = F.col(paid).cast("double"), F.col(received).cast("double")
    cross = df.where((F.col("payment_currency") != F.col("receiving_currency")) & (p > 0) & (r > 0))
    logs = cross.select(F.col("payment_currency").alias("pay"), F.col("receiving_currency").alias("receive"), F.ln(r / p).alias("x"))
    found = quantiles(materialised(logs, "log-ratios"), ["pay", "receive"], "x", [0.5])
    return found.select("pay", "receive", F.col("q")[0].alias("median"), "n")


def reachable(anchor: str, links: list[tuple[str, str]]) -> set[str]:
    """Currencies connected to the anchor; the graph has as many nodes as there are currencies."""
    sets = {anchor: {anchor}}
    for a, b in links:
        joined = sets.get(a, {a}) | sets.get(b, {b})
        for x in joined:
            sets[x] = joined
    return sets[anchor]


@dataclass(frozen=True)
class Rates:
    anchor: str
    log_rates: dict[str, float]
    max_abs_log_residual: float

    def report(self) -> dict:
        return {"anchor": self.anchor, "log_rates": self.log_rates, "max_abs_log_residual": self.max_abs_log_residual}


def fit_rates(df: DataFrame, anchor: str = ANCHOR_CURRENCY, paid: str = "amount_paid", received: str = "amount_received") -> Rates:
    """Weighted least squares over pair medians (a table of currencies squared, solved on the driver)."""
    names = sorted(r[0] for r in df.select(F.explode(F.array("payment_currency", "receiving_currency")).alias("c")).distinct().collect())
    if anchor not in names:
        raise ValueError(f"anchor currency {anchor!r} is absent")
    pairs = [tuple(r) for r in pair_medians(df, paid, received).collect()]
    apart = sorted(set(names) - reachable(anchor, [p[:2] for p in pairs]))
    if apart:
        raise ValueError(f"no exchange rate can be inferred for: {apart}")
    free = [n for n in names if n != anchor]
    a = np.array([[(n == pay) - (n == got) for n in free] for pay, got, _, _ in pairs], float).reshape(len(pairs), len(free))
    b = np.array([m for _, _, m, _ in pairs])
    w = np.sqrt([n for *_, n in pairs])
    solved = np.linalg.lstsq(a * w[:, None], b * w, rcond=None)[0] if free else np.zeros(0)
    left = np.abs(b - a @ solved).max() if len(pairs) and free else 0.0
    return Rates(anchor, {anchor: 0.0, **dict(zip(free, map(float, solved), strict=True))}, float(left))


def rates_table(spark, rates: Rates) -> DataFrame:
    return spark.createDataFrame(sorted(rates.log_rates.items()), "currency string, log_rate double")


def to_anchor(df: DataFrame, rates: Rates, check: bool = True) -> DataFrame:
    """Adds amount_paid_usd and amount_received_usd; a currency without a rate is an error."""
    table = F.broadcast(rates_table(df.sparkSession, rates))  # one row per currency
    out = df
    for amount, currency in (("amount_paid", "payment_currency"), ("amount_received", "receiving_currency")):
        one = table.select(F.col("currency").alias(currency), F.exp("log_rate").alias(f"_{currency}"))
        out = out.join(one, currency, "left").withColumn(f"{amount}_usd", F.col(amount) * F.col(f"_{currency}")).drop(f"_{currency}")
    if check:
        known = list(rates.log_rates)
        unknown = df.select(F.explode(F.array("payment_currency", "receiving_currency")).alias("c")).where(~F.col("c").isin(known)).distinct().limit(20).collect()
        if unknown:
            raise ValueError(f"no exchange rate for: {sorted(r[0] for r in unknown)}")
    return out.select(*df.columns, "amount_paid_usd", "amount_received_usd")


def rate_of(rates: Rates, currency: str) -> float:
    return math.exp(rates.log_rates[currency])
