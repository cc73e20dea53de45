"""Approximate nearest neighbours: an inverted file of coarse centroids, product-quantised residuals, exact reranking.

Centroids and code books are fitted on a bounded sample; every valid vector is indexed. How many of its nearest cells a
query probes is measured there: so many that ``reach`` of the true neighbours of sample rows lie in them, at least
``probes``, and on until they hold enough vectors for a full answer. Vectors that cluster need few cells, others most.
Asymmetric distance tables
rank their codes, and the best ``rerank`` of a query's cells together are measured again on the original vectors in
double precision. The ``first`` nearest cells go first: a query's ``rerank``-th best there bounds what its other cells
pass on, so few candidates move and none of the best is lost.

Cells split into parts of at most ``PART`` rows and queries into blocks of at most ``BLOCK``, so a cell that holds a
third of all vectors is shared by many tasks. Equal distances go to the smaller id at every step. Vectors that are
null, zero, of another length than most, or hold a null or non-finite component take no part, nor does a null id. Repeated rows
are candidates each; of rows that share a query's id the smallest vector asks. Fewer candidates than asked for are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.llm.common import Held, written

PART, BLOCK = 20_000, 2_000


@dataclass(frozen=True)
class Settings:
    """``cells`` bounds the inverted file (sqrt(rows) / 2 cells up to there); the fit takes ``sample`` rows or 16 a cell."""

    sample: int = 16_384
    cells: int = 4096
    reach: float = 0.98
    tried: int = 512
    probes: int = 12
    codes: int = 16
    first: int = 4
    rerank: int = 300
    seed: int = 11


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centroids of Lloyd's rounds from distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    square = (c * c).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (square - 2 * x[at : at + 4096] @ c.T).argmin(1)
    return out


@dataclass
class Index:
    centroids: np.ndarray  # (cells, dimensions)
    books: list[np.ndarray]  # per code: (entries, its dimensions)
    cuts: list[int]
    probes: int  # nearest cells that hold ``reach`` of the neighbours

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        codes = [nearest(rest[:, a:b], book).astype(np.uint8) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        return cell, np.stack(codes, 1)

    def tables(self, q: np.ndarray, cell: int) -> list[np.ndarray]:
        """Per code, squared distances of each query's residual to each entry: (queries, entries)."""
        rest = q - self.centroids[cell]
        return [((rest[:, None, a:b] - book[None]) ** 2).sum(2).astype(np.float32) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, whatever their length."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def fit(rows: DataFrame, count: int, settings: Settings) -> Index:
    """Fit on the rows whose ids hash lowest."""
    cells = int(min(settings.cells, max(1, count**0.5 / 2)))
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(settings.sample, 16 * cells)).select("vec").collect()])
    centroids = kmeans(sample, cells, settings.seed)
    rest = sample - centroids[nearest(sample, centroids)]
    wide = sample.shape[1]
    cuts = sorted({wide * i // min(wide, settings.codes) for i in range(min(wide, settings.codes) + 1)})
    books = [kmeans(rest[:8192, a:b], 256, settings.seed + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return Index(centroids, books, cuts, probes_for(sample, centroids, settings))


def probes_for(sample: np.ndarray, centroids: np.ndarray, settings: Settings, k: int = 10) -> int:
    """How many nearest cells hold ``reach`` of the ``k`` nearest sample rows of each of the first ``tried``."""
    asked, own = sample[: settings.tried], nearest(sample, centroids)
    ranks = []
    for at in range(0, len(asked), 64):
        q = asked[at : at + 64]
        distance = (sample * sample).sum(1) - 2 * q @ sample.T
        distance[np.arange(len(q)), at + np.arange(len(q))] = np.inf
        near = np.argsort(distance, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort((centroids * centroids).sum(1) - 2 * q @ centroids.T, axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, own[near], axis=1).ravel())
    ranks = np.concatenate([np.zeros(1, np.int64), *ranks])
    return max(settings.probes, int(np.quantile(ranks, settings.reach, method="higher")) + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each row of ``vectors`` where ``is_query`` holds.

    ``is_query`` is a condition on the id, which is called ``id`` there.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    sizes = sorted(((r[1], -r[0]) for r in rows.groupBy(F.size("vec")).count().collect()), reverse=True)
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if not sizes:
        return empty
    count, wide = sizes[0][0], -sizes[0][1]
    rows = rows.where(F.size("vec") == wide)
    index = fit(rows, count, settings)
    held = Held(spark, index)  # at most ``cells`` + 256 rows of doubles

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                cell, codes = held.value.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in codes], pa.binary())], ["id", "cell", "codes"])

    coded = written(rows.mapInArrow(encode, "id long, cell int, codes binary"), "codes")
    in_cell = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("cell").count().collect():  # at most ``cells`` rows
        in_cell[r[0]] = r[1]
    probes = index.probes
    asked = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))

    def probe(batches):
        c = held.value.centroids
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            order = np.argsort((c * c).sum(1) - 2 * q @ c.T, axis=1, kind="stable")
            enough = np.cumsum(in_cell[order], axis=1) >= k + 1
            take = np.where(enough.any(1), np.maximum(enough.argmax(1) + 1, probes), len(c))
            at = np.repeat(np.arange(len(q)), np.minimum(take, len(c)))
            cell = np.concatenate([order[i, :n] for i, n in enumerate(take)])
            place = np.concatenate([np.arange(min(n, len(c))) for n in take])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(place.astype(np.int32))], ["query_id", "cell", "place"])

    pairs = written(asked.mapInArrow(probe, "query_id long, cell int, place int"), "probes")
    asked_in = {r[0]: r[1] for r in pairs.groupBy("cell").count().collect()}  # at most ``cells`` rows
    parts = [max(1, -(-int(n) // PART)) for n in in_cell]
    blocks = [max(1, -(-asked_in.get(i, 0) // BLOCK)) for i in range(len(in_cell))]
    part_of = F.element_at(F.array(*[F.lit(x) for x in parts]), F.col("cell") + 1)
    block_of = F.element_at(F.array(*[F.lit(x) for x in blocks]), F.col("cell") + 1)
    left = coded.withColumn("part", F.pmod(F.xxhash64("id"), part_of).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), block_of - 1)))
    right = pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), block_of).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), part_of - 1)))
    right = right.join(asked.select(F.col("id").alias("query_id"), "vec"), "query_id")
    best = settings.rerank

    def rank(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [[], [], []]
        if one.num_rows and two.num_rows:
            one = one.combine_chunks().sort_by("id")
            ids = one.column("id").to_numpy()
            codes = np.frombuffer(b"".join(one.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            names = two.column("query_id").to_numpy()
            bounds = two.column("bound").to_numpy()
            q = np.array(two.column("vec").to_pylist())
            cell = one.column("cell")[0].as_py()
            for at in range(0, len(q), 32):
                tables = held.value.tables(q[at : at + 32], cell)
                score = tables[0][:, codes[:, 0]]
                for j in range(1, len(tables)):
                    score = score + tables[j][:, codes[:, j]]
                for i, name in enumerate(names[at : at + 32]):
                    s, edge = score[i], bounds[at + i]
                    if len(s) > best + 1:
                        edge = min(edge, np.partition(s, best)[best])
                    near = np.flatnonzero(s <= edge)
                    if len(near) > best + 1:  # of equal ones the smaller ids, in which order they are
                        below = np.flatnonzero(s < edge)
                        near = np.concatenate([below, np.flatnonzero(s == edge)[: best + 1 - len(below)]])
                    near = near[ids[near] != name]
                    out[0].append(np.full(len(near), name))
                    out[1].append(ids[near])
                    out[2].append(s[near].astype(np.float64))
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate([np.zeros(0, t), *x])) for x, t in zip(out, kinds, strict=True)], ["query_id", "id", "rough"])

    keys = ["cell", "part", "block"]
    order = Window.partitionBy("query_id").orderBy("rough", "id")

    def ranked(some: DataFrame) -> DataFrame:
        return left.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(rank, "query_id long, id long, rough double")

    near = written(ranked(right.where(F.col("place") < settings.first).withColumn("bound", F.lit(float("inf")))).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= best), "nearest-cells")
    bound = near.where(F.col("rn") == best).select("query_id", F.col("rough").alias("bound"))
    far = right.where(F.col("place") >= settings.first).join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    rough = near.drop("rn").unionByName(ranked(far))
    chosen = rough.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= best).select("query_id", "id")
    both = chosen.distinct().join(rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), "query_id")

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((a - b) ** 2).sum(1)))], ["query_id", "id", "score"])

    exact = both.select("query_id", "id", "vec", "query_vec").mapInArrow(measure, "query_id long, id long, score double")
    final = Window.partitionBy("query_id").orderBy("score", "id")
    return exact.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op1_ann(spark, sf_dir):
    from strictpast.llm.common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
