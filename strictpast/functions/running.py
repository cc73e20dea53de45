"""Running sums over one global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strictpast.plans.storage import materialised


#: Rows of a bucket, which one task orders.
BUCKET_ROWS = 500_000


def running_sums(df: DataFrame, by: str, sums: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """Adds ``run_<c>`` for each c: the sum over all rows before and at the row's value of ``by``.

    Rows are cut into ordered buckets by range; each bucket is summed on its own and shifted by the totals of the buckets
    before it (a row each). There are as many as the rows need, or ``parts``. ``by`` should be distinct per row or ties
    share the sum.
    """
    df = materialised(df, "running")  # read more than once
    parts = parts or max(1, -(-df.count() // BUCKET_ROWS))
    if parts == 1:
        cut = df.withColumn("_bucket", F.lit(0))
    else:  # written, so that both branches below see one and the same cut
        cut = materialised(df.repartitionByRange(parts, by).withColumn("_bucket", F.spark_partition_id()), "buckets")
    order = F.desc if descending else F.asc
    totals = cut.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy("_bucket").orderBy(order(by)).rangeBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(shift), "_bucket")  # ``parts`` rows
    return out.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_s_{c}")).alias(f"run_{c}") for c in sums])
