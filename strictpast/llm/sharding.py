"""Sharding by extendible hashing: a directory over hash-prefix bits whose oversized buckets alone split further.

The hash mixes the id with the content, so null or repeated ids spread. A bucket is a prefix of ``depth`` bits; it
splits on the next bit until its bytes fit the limit. Rows that agree on all bits are copies of one another: they
fill overflow pages of the same bucket, page by page, as many as fit each. A single row over the limit makes a shard
of its own and is marked ``oversized``. Null texts have no bytes. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import written

#: Bits of the hash that a directory may use.
BITS = 60
#: Leaves (24 bytes each) up to which the directory is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), F.md5(text.cast("binary")))
    code = F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return docs.select(F.col(id_col).alias("id"), code.alias("code"), F.octet_length(text).cast("long").alias("bytes"))


def directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Leaves of the directory over rows (code, bytes): prefix, depth, bytes. All prefixes are disjoint.

    Sizes are summed at ``step`` more bits than a pass starts from, then rolled up; only leaves that are still too
    large go on to the next pass. Every pass is an aggregate whose map side collapses to the number of prefixes.
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    start = max(0, min(BITS - step, (max(1, total // max(1, limit))).bit_length() - 2))
    leaves, open_rows, low = None, rows, 0
    deep = min(BITS, start + step)
    while True:
        fine = open_rows.groupBy(F.shiftright("code", BITS - deep).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("codes"))
        fine = written(fine, "prefixes")
        every = fine.select(F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth"), "p", "bytes", "codes")
        sums = every.groupBy("depth", F.expr(f"shiftright(p, {deep} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("codes").alias("codes"))
        sums = written(sums, "buckets")
        settled = (F.col("bytes") <= limit) | (F.col("codes") == 1) | F.lit(deep >= BITS) & (F.col("depth") == deep)
        over = sums.where(~settled).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fit = sums.where(settled).withColumn("parent", F.shiftright("prefix", 1))
        found = fit.join(over, ["depth", "parent"], "left_semi").select("prefix", "depth", "bytes")
        if low == 0:
            found = found.unionByName(fit.where("depth = 0").select("prefix", "depth", "bytes"))
        leaves = found if leaves is None else leaves.unionByName(found)
        wide = sums.where((F.col("depth") == deep) & ~settled).select(F.col("prefix").alias("q"))
        if deep >= BITS or wide.isEmpty():
            return leaves
        open_rows = open_rows.join(wide, F.shiftright("code", BITS - deep) == F.col("q"), "left_semi")
        low, deep = deep, min(BITS, deep + step)


def shard(docs: DataFrame, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, shard (its prefix bits, ``.page`` after them in overflow pages), depth, bytes, oversized."""
    grouped = written(_keyed(docs, id_col, text_col).groupBy("id", "code", "bytes").agg(F.count("*").alias("n")), "sharding")
    whole = grouped.withColumn("bytes", F.col("bytes") * F.col("n"))
    leaves = written(directory(whole, limit), "leaves")
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61 values
    choices = F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array(F.lit(0))
    cells = grouped.select("*", F.explode(choices).alias("depth")).withColumn("prefix", F.expr(f"shiftright(code, {BITS} - depth)"))
    leaf = leaves.select("prefix", "depth", F.col("bytes").alias("bucket_bytes"))
    placed = cells.join(F.broadcast(leaf) if leaves.count() <= MOST_BROADCAST else leaf, ["depth", "prefix"])
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    pages = F.when(F.col("bucket_bytes") > limit, F.floor((F.col("copy") - 1) / per_page)).cast("long")
    name = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0")
    name = F.concat(F.lit("b"), F.when(F.col("depth") > 0, name).otherwise(""))
    rows = placed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return rows.select(F.col("id").alias(id_col), F.concat(name, F.coalesce(F.concat(F.lit("."), pages.cast("string")), F.lit(""))).alias("shard"), F.col("depth").cast("int").alias("depth"), "bytes", (F.col("bytes") > limit).alias("oversized"))


#: The registered query's byte limit: small enough that the smallest tables fill a directory of several depths.
LIMIT = 256 << 10


def op10_sharding(spark, sf_dir):
    from strictpast.llm.common import table

    return shard(table(spark, sf_dir, "documents"), LIMIT)


def sharding_sql(limit: int = LIMIT) -> str:
    """The directory's definition, not its algorithm: a row's depth is the first at which its prefix is settled."""
    return f"""
WITH k AS (SELECT doc_id, md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
c AS (SELECT doc_id, bytes, ('0x' || substr(h, 1, 15))::BIGINT AS code, row_number() OVER (PARTITION BY doc_id, h) AS copy FROM k),
g AS (SELECT doc_id, bytes, code, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT d.depth, g.code >> ({BITS} - d.depth)::INTEGER AS prefix, sum(bytes * n) AS total, count(*) AS codes FROM g, (SELECT unnest(range({BITS + 1}))::INTEGER AS depth) d GROUP BY ALL),
s AS (SELECT * FROM e WHERE total <= {limit} OR codes = 1 OR depth = {BITS}),
m AS (SELECT g.doc_id, g.bytes, g.code, min(s.depth) AS depth FROM g JOIN s ON s.prefix = g.code >> ({BITS} - s.depth)::INTEGER GROUP BY ALL),
p AS (SELECT c.doc_id, c.bytes, c.code, m.depth, CASE WHEN e.total > {limit} THEN '.' || ((copy - 1) // greatest(1, {limit} // greatest(c.bytes, 1))) ELSE '' END AS page
  FROM c JOIN m USING (doc_id, bytes, code) JOIN e ON e.depth = m.depth AND e.prefix = c.code >> ({BITS} - m.depth)::INTEGER)
SELECT doc_id, 'b' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(code >> ({BITS} - depth)::INTEGER), depth, '0') END || page AS shard, depth, bytes, bytes > {limit} AS oversized FROM p
"""
