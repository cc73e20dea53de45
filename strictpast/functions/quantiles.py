"""Exact interpolated quantiles by group, however many rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.functions.running import running_sums

#: Rows up to which one task may sort out a group's distinct values.
ONE_TASK = 5_000_000


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float], one_task: int = ONE_TASK) -> DataFrame:
    """(groups, q: array<double>, n): the linearly interpolated quantiles of the values that are not null.

    More than ``one_task`` rows are counted by distinct value, counts run over all values in order by ranges, and the two
    values around each quantile's place are picked by one aggregate: no task holds a group. Both ways give equal results.
    """
    rows = df.select(*groups, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    if df.count() <= one_task:
        return rows.groupBy(*groups).agg(F.percentile("x", F.array(*[F.lit(float(s)) for s in shares])).alias("q"), F.count("*").alias("n")).where("n > 0")
    steps = rows.groupBy(*groups, "x").agg(F.count("*").alias("n")).withColumn("k", F.struct(*groups, "x"))
    run = running_sums(steps, "k", ["n"])
    own = [f"_own_{i}" for i in range(len(groups))]
    totals = run.groupBy(*[F.col(g).alias(o) for g, o in zip(groups, own, strict=True)]).agg(F.sum("n").alias("n_all"), F.min(F.col("run_n") - F.col("n")).alias("before"))
    same = F.lit(True)
    for g, o in zip(groups, own, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(o))
    # A row a group; the values' side is as large as it likes.
    upto = F.col("run_n") - F.col("before")
    placed = run.join(F.broadcast(totals), same).select(*groups, "x", "n_all", upto.alias("upto"), (upto - F.col("n")).alias("from"))
    picked = []
    for s in shares:
        place = F.lit(float(s)) * (F.col("n_all") - 1)
        low, high = (F.max(F.when((F.col("from") <= f(place)) & (f(place) < F.col("upto")), F.col("x"))) for f in (F.floor, F.ceil))
        part = F.lit(float(s)) * (F.max("n_all") - 1)
        picked.append(low + (high - low) * (part - F.floor(part)))
    return placed.groupBy(*groups).agg(F.array(*picked).alias("q"), F.max("n_all").alias("n"))
