"""Ledger readers: CSV and Parquet, typed and projected to the contract, with provenance."""

from __future__ import annotations

import hashlib
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.operators.sampling import sample_senders
from strictpast.schema import AMOUNTS, RAW_TO_OWN
from strictpast.sources.files import Files

SAMPLE_RATE = 50
#: Bytes of a file from which on it is digested as a stream.
WHOLE = 1 << 29
_PRIMARY = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}$"


@dataclass(frozen=True)
class Provenance:
    path: str
    format: str
    sha256: str
    size_bytes: int
    extracted_rows: int
    sampled: bool

    def to_dict(self) -> dict:
        return asdict(self)


def sha256_of(path: str, chunk_size: int = 1 << 20) -> str:
    """Digest of a local file, a chunk at a time."""
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk_size):
            digest.update(part)
    return digest.hexdigest()


def source_digest(spark: SparkSession, path: str) -> str:
    """Digest of a local file, or of the sorted digests of the files at ``path`` on any store.

    Files under ``WHOLE`` bytes are digested by tasks, larger ones, which no value can hold, from a stream.
    """
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        return sha256_of(local)
    found = spark.read.format("binaryFile").load(path)
    parts = [r[0] for r in found.where(F.col("length") < WHOLE).select(F.sha2("content", 256)).collect()]  # one row per file
    parts += [Files(spark).sha256(r[0]) for r in found.where(F.col("length") >= WHOLE).select("path").collect()]
    return hashlib.sha256("".join(sorted(parts)).encode()).hexdigest()


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", False).csv(path).limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    names, seen = [], set()
    for raw in first[0]:
        name = (raw or "").lstrip("﻿").strip()
        if name in seen and name == "Account":
            name = "Account.1"
        names.append(name)
        seen.add(name)
    if sorted(names) != sorted(RAW_TO_OWN):
        raise ValueError(f"unexpected CSV columns: {names}")
    return names


def parse_timestamps(df: DataFrame, column: str) -> DataFrame:
    """``column`` from strings to TIMESTAMP_NTZ: all rows as 2022/09/01 00:20, or else all as ISO 8601."""
    text = F.col(column)
    primary = text.rlike(_PRIMARY)
    rows, fit = df.agg(F.count("*"), F.count_if(F.coalesce(primary, F.lit(False)))).first()
    if rows == fit:
        iso = F.concat(F.translate(text, "/", "-"), F.lit(":00"))
        return df.withColumn(column, iso.try_cast("timestamp_ntz"))
    parsed = text.try_cast("timestamp_ntz")
    bad = df.where(text.isNull() | parsed.isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"timestamps fit neither format, such as {bad[0][column]!r}")
    return df.withColumn(column, parsed)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns in any order, the second ``Account`` as the receiver's. Fields that are no number become null and fail validation."""
    names = _header(spark, path)
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    typed = raw.select(*[(F.col(f"`{n}`").try_cast("double") if own in AMOUNTS else F.col(f"`{n}`").try_cast("tinyint") if own == "label" else F.col(f"`{n}`")).alias(own) for n, own in RAW_TO_OWN.items()])
    return parse_timestamps(typed, "ts")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    missing = sorted(set(RAW_TO_OWN) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kinds = {"ts": "timestamp_ntz", "label": "tinyint"} | {c: "double" for c in AMOUNTS}
    if dict(raw.dtypes)["Timestamp"] == "string":
        return parse_timestamps(raw.select(*[F.col(f"`{n}`").cast("string" if own == "ts" else kinds.get(own, "string")).alias(own) for n, own in RAW_TO_OWN.items()]), "ts")
    return raw.select(*[F.col(f"`{n}`").cast(kinds.get(own, "string")).alias(own) for n, own in RAW_TO_OWN.items()])


def with_tx_id(df: DataFrame) -> DataFrame:
    """A row number for re-joining; equal rows stay apart. Write the result before using it twice."""
    return df.withColumn("tx_id", F.monotonically_increasing_id())


def extract(spark: SparkSession, path: str, sample: bool = False) -> tuple[DataFrame, Provenance]:
    """The ledger at ``path`` (.csv or .parquet); ``sample`` keeps the complete histories of 1 in 50 senders."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "parquet": read_parquet}
    if kind not in readers:
        raise ValueError(f"unsupported source: {path}")
    if not Files(spark).exists(path):
        raise FileNotFoundError(path)
    df = readers[kind](spark, path)
    if sample:
        df = sample_senders(df, SAMPLE_RATE)
    return df, Provenance(path, kind, source_digest(spark, path), Files(spark).size(path), df.count(), sample)
