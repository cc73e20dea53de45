"""Contract checks and the quality report, each as one aggregate over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.schema import AMOUNTS, COLUMNS, IDENTIFIERS, PAYMENT_FORMATS


def gate_conditions(columns=COLUMNS) -> dict[str, Column]:
    """Violations by name; each is true for a row that breaks the contract."""
    out = {f"null_{c}": F.col(c).isNull() for c in columns}
    out |= {f"empty_{c}": F.col(c) == "" for c in IDENTIFIERS if c in columns}
    out |= {f"bad_{c}": F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) < 0) for c in AMOUNTS if c in columns}
    if "label" in columns:
        out["bad_label"] = ~F.col("label").isin(0, 1)
    if "payment_format" in columns:
        out["bad_payment_format"] = ~F.col("payment_format").isin(*PAYMENT_FORMATS)
    return out


def gate_violations(df: DataFrame, columns=COLUMNS) -> DataFrame:
    """One row: rows, and how many break each rule."""
    rules = gate_conditions(columns)
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])


def validate_ledger(df: DataFrame) -> DataFrame:
    """The contract's columns of ``df`` after all gates hold; raises ValueError naming what does not."""
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    extra = [c for c in df.columns if c not in COLUMNS and c == "tx_id"]
    found = gate_violations(df).first().asDict()
    if found.pop("rows") == 0:
        raise ValueError("the ledger is empty")
    broken = {k: v for k, v in found.items() if v}
    if broken:
        if "bad_payment_format" in broken:
            names = df.where(~F.col("payment_format").isin(*PAYMENT_FORMATS)).select("payment_format").distinct().limit(20).collect()
            broken["bad_payment_format"] = sorted(r[0] for r in names)
        raise ValueError(f"contract violations: {broken}")
    kinds = {"ts": "timestamp_ntz", "label": "tinyint"} | {c: "double" for c in AMOUNTS}
    return df.select(*extra, *[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(duplicate_rows): rows beyond the first of each set of equal rows. Duplicates stay in the ledger."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row of scalars over the ledger."""
    zero = (F.col("amount_paid") == 0) | (F.col("amount_received") == 0)
    self_transfer = (F.col("from_bank") == F.col("to_bank")) & (F.col("from_account") == F.col("to_account"))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(zero).alias("zero_amount_rows"),
        F.count_if(self_transfer).alias("self_transfers"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def pooled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of several columns counted together."""
    return df.select(F.explode(F.array(*columns)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def daily_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"), F.sum(F.col("label").cast("long")).alias("positives"))
