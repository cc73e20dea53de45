"""Row-wise expressions, all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_CAP = 1e6


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ column, whatever the session zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def epoch_micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def floor_unit(seconds: Column, unit: int) -> Column:
    """The start of the ``unit``-second period that holds ``seconds``."""
    return F.floor(seconds / F.lit(unit)) * unit


def floored(amount: Column) -> Column:
    return F.greatest(amount, F.lit(0).cast("double"))


def safe_log1p(value: Column) -> Column:
    return F.log1p(value.cast("double"))


def capped_ratio(top: Column, bottom: Column, otherwise: Column) -> Column:
    """log1p(min(top / bottom, cap)) where bottom > 0."""
    return F.when(bottom > 0, F.log1p(F.least(top.cast("double") / bottom.cast("double"), F.lit(RATIO_CAP)))).otherwise(otherwise)


def hour_features(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    angle = hour * (2 * math.pi / 24)
    return {"hour": hour.cast("byte"), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "is_night": hour.between(0, 5).cast("byte")}


def flag_features() -> dict[str, Column]:
    same_bank = F.col("from_bank") == F.col("to_bank")
    return {
        "is_currency_same": (F.col("payment_currency") == F.col("receiving_currency")).cast("byte"),
        "is_same_bank": same_bank.cast("byte"),
        "is_self_transfer": (same_bank & (F.col("from_account") == F.col("to_account"))).cast("byte"),
    }


def amount_features(paid: str = "amount_paid_usd", received: str = "amount_received_usd") -> dict[str, Column]:
    p, r = floored(F.col(paid)), floored(F.col(received))
    both = (p > 0) & (r > 0)
    return {"amount_paid_usd_log": F.log1p(p), "amount_received_usd_log": F.log1p(r), "fx_log_deviation": F.when(both, F.ln(r / F.when(both, p))).otherwise(F.lit(0.0))}


def roundness(paid: str = "amount_paid") -> dict[str, Column]:
    return {f"is_round_{base}": (F.abs(F.col(paid) % base) <= 1e-8).cast("byte") for base in (10, 100, 1000)}


def basic_features(ts: str = "ts") -> dict[str, Column]:
    """The 13 row-wise columns of a USD-enriched ledger."""
    return {**hour_features(F.col(ts)), **flag_features(), **amount_features(), **roundness()}
