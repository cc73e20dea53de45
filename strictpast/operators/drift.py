"""Population stability of features between two tables, all features in one pass over long rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strictpast.functions.quantiles import quantiles
from strictpast.plans.storage import materialised


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    return df.select(F.explode(pairs).alias("p")).select("p.*").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def _next(x: float, up: bool) -> float:
    return math.nextafter(x, math.inf if up else -math.inf)


def bin_edges(reference: DataFrame, features: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner edges per feature: distinct interpolated quantiles, minimum and maximum included.

    A feature with one value gets edges next to it on both sides, one without values those next to 0. At most
    (features x (bins + 1)) numbers.
    """
    found = {r["feature"]: r["q"] for r in quantiles(_long(reference, features), ["feature"], "x", [i / bins for i in range(bins + 1)]).collect()}
    out = {}
    for f in features:
        edges = sorted(set(found.get(f) or []))
        if len(edges) < 2:
            middle = edges[0] if edges else 0.0
            edges = [_next(middle, False), _next(middle, True)]
        out[f] = edges
    return out


def drift_report(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10, limit: float = 0.2) -> DataFrame:
    """(feature, psi, investigate, missing_reference, missing_current).

    A bin holds the values from its lower edge up to, not including, its upper; nulls and NaN have a bin of their own;
    every bin counts half a row more.
    """
    narrow = lambda df, old: df.select(F.lit(old).alias("old"), *[F.col(c).cast("double").alias(c) for c in features])
    both = materialised(narrow(reference, 1).unionByName(narrow(current, 0)), "drift")  # read for the edges and for the bins
    edges = bin_edges(both.where("old = 1"), features, bins)
    spark = reference.sparkSession
    slots = [(f, b) for f in features for b in range(-1, len(edges[f]) + 1)]
    grid = F.broadcast(spark.createDataFrame(slots, "feature string, bin int"))  # features x bins

    def bin_of(c: str) -> Column:
        x = F.when(~F.isnan(c), F.col(c))
        return F.when(x.isNull(), -1).otherwise(sum([(F.lit(e) <= x).cast("int") for e in edges[c]], F.lit(0)))

    cells = both.select("old", *[bin_of(c).alias(f"b{i}") for i, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b{i}").alias("bin")) for i, c in enumerate(features)])
    counts = cells.select("old", F.explode(pairs).alias("p")).select("old", "p.*").groupBy("feature", "bin").agg(F.sum("old").alias("a"), F.sum(1 - F.col("old")).alias("b"))
    full = grid.join(counts, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = full.groupBy("feature").agg(F.sum(F.col("a") + 0.5).alias("ta"), F.sum(F.col("b") + 0.5).alias("tb"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = (F.col("a") + 0.5) / F.col("ta"), (F.col("b") + 0.5) / F.col("tb")
    missing = lambda c, n: F.when(F.first(n) > 0, F.sum(F.when(F.col("bin") == -1, F.col(c)).otherwise(0)) / F.first(n).cast("double"))
    out = full.join(totals, "feature").groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), missing("a", "na").alias("missing_reference"), missing("b", "nb").alias("missing_current"))
    return out.select("feature", "psi", (F.col("psi") >= limit).alias("investigate"), "missing_reference", "missing_current")
