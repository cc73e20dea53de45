"""Ledgers made from the driver's tables, in whole cents so that sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.functions.expressions import epoch_seconds
from strictpast.schema import PAYMENT_FORMATS

#: Millionths of the anchor (the first) that a unit of each region's currency is worth.
RATES = {"AFRICA": 1_000_000, "AMERICA": 1_100_000, "ASIA": 900_000, "EUROPE": 1_250_000, "MIDDLE EAST": 700_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rate(region) -> F.Column:
    out = F.lit(None).cast("long")
    for name, value in RATES.items():
        out = F.when(region == name, F.lit(value).cast("long")).otherwise(out)
    return out


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payments from customers to suppliers."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("payment_currency"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("receiving_currency"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    sender, receiver = F.col("o_custkey") % 97, F.col("l_suppkey") % 97
    paid = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = rows.withColumn("paid", paid).withColumn("_own", _rate(F.col("payment_currency"))).withColumn("_other", _rate(F.col("receiving_currency")))
    rows = rows.withColumn("_even", F.expr("(paid * _own) div _other"))
    off = F.lit(10_000) - F.round(F.col("l_discount") * 100).cast("long")
    formats = F.array(*[F.lit(x) for x in PAYMENT_FORMATS])
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount",
        F.col("l_shipdate").alias("ts"),
        epoch_seconds("l_shipdate").alias("sec"),
        (sender % 3).cast("string").alias("from_bank"), sender.cast("string").alias("from_account"),
        (receiver % 3).cast("string").alias("to_bank"), receiver.cast("string").alias("to_account"),
        "paid", "_even", off.alias("_off"),
        "payment_currency", "receiving_currency",
        F.element_at(formats, (F.col("l_partkey") % 7 + 1).cast("int")).alias("payment_format"),
        ((F.col("l_orderkey") * 31 + F.col("l_partkey")) % 20 == 0).cast("int").alias("label"),
        ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 1000 / F.lit(1000.0)).alias("score"),
    ).withColumn("received", F.expr("(_even * _off) div 10000")).drop("_even", "_off")


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payments from users to 40 accounts."""
    events = table(spark, sf_dir, "events")
    receiver = F.col("event_id") % 40
    paid = F.round(F.col("value") * 100).cast("long")
    return events.select(
        "event_id", "ts", epoch_seconds("ts").alias("sec"),
        (F.col("user_id") % 3).cast("string").alias("from_bank"), F.col("user_id").cast("string").alias("from_account"),
        (receiver % 3).cast("string").alias("to_bank"), receiver.cast("string").alias("to_account"),
        paid.alias("paid"), paid.alias("received"), "event_type",
        (F.col("event_type") == "error").cast("int").alias("label"),
        ((F.col("event_id") * 37 + F.col("user_id") * 11) % 1000 / F.lit(1000.0)).alias("score"),
    )


_NATIONS = "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
_RATE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATES.items()) + " END"
_FORMATS = "[" + ", ".join(f"'{x}'" for x in PAYMENT_FORMATS) + "]"

#: DuckDB: the same ledgers, as queries.
ORDER_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, ts, sec, from_bank, from_account, to_bank, to_account, paid,
       payment_currency, receiving_currency, payment_format, label, score, (even * off) // 10000 AS received
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_shipdate AS ts, CAST(epoch(l_shipdate) AS BIGINT) AS sec,
        CAST(o_custkey % 97 % 3 AS VARCHAR) AS from_bank, CAST(o_custkey % 97 AS VARCHAR) AS from_account,
        CAST(l_suppkey % 97 % 3 AS VARCHAR) AS to_bank, CAST(l_suppkey % 97 AS VARCHAR) AS to_account,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS paid, c.r_name AS payment_currency, s.r_name AS receiving_currency,
        {_FORMATS}[CAST(l_partkey % 7 + 1 AS INTEGER)] AS payment_format, CAST((l_orderkey * 31 + l_partkey) % 20 = 0 AS INTEGER) AS label,
        ((l_partkey * 37 + l_orderkey * 11) % 1000) / 1000.0::DOUBLE AS score,
        CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * ({_RATE.format(c="c.r_name")}) // ({_RATE.format(c="s.r_name")}) AS BIGINT) AS even,
        10000 - CAST(round(l_discount * 100) AS BIGINT) AS off
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN ({_NATIONS}) c ON c_nationkey = c.n_nationkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN ({_NATIONS}) s ON s_nationkey = s.n_nationkey)
"""
EVENT_SQL = """
SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(user_id % 3 AS VARCHAR) AS from_bank, CAST(user_id AS VARCHAR) AS from_account,
       CAST(event_id % 40 % 3 AS VARCHAR) AS to_bank, CAST(event_id % 40 AS VARCHAR) AS to_account,
       CAST(round(value * 100) AS BIGINT) AS paid, CAST(round(value * 100) AS BIGINT) AS received, event_type,
       CAST(event_type = 'error' AS INTEGER) AS label, ((event_id * 37 + user_id * 11) % 1000) / 1000.0::DOUBLE AS score
FROM events
"""
