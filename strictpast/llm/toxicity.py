"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Terms are words: runs of ASCII letters and digits and of all non-ASCII characters, lower-cased. The labelled sample has
at most ``per_label`` rows of each label, and every term of its whole texts is a dimension. A term weighs its inverse
document frequency times how far its share among toxic rows stands from that of all rows, in standard deviations and
with a floor above 0, so no term is dropped and terms that tell nothing count little; a text's vector is (1 + log
count) x weight over its whole text, of length 1. The index keeps postings in blocks of alike sample rows with each
term's largest weight per block: blocks whose bound can't reach the k-th best similarity are skipped, so the neighbours
are exactly the nearest.

Neighbours vote with weights that grow as the distance shrinks, corrected for how the sample was drawn; votes become
probabilities by a logistic fit on leave-one-out votes of the sample. A text that shares no term with the sample, such
as a null or empty one, gets the rate of labelled texts like it. Equal similarities go to the row first in the sample's
order (hash of the id). Null labels or ids are not learned from; of repeated labels for an id each counts. Without both
labels every score is the (smoothed) rate of what there is, 0 without any. Repeated rows are scored each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import Held, bounded_sample, crc32_of_id, written

#: ASCII letters and digits and all other bytes stay, the rest separates.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the labelled sample, ``floor`` is what a term without any tie to the label counts."""

    per_label: int = 2500
    floor: float = 0.1
    neighbours: int = 15
    block: int = 64


def words(text: str | None) -> Counter:
    return Counter((text or "").lower().encode().translate(_WORDS).split())


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, int]]:
    """(rn, id, toxic, text) of the sample, and how many labelled rows there are of each label."""
    named = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in named.groupBy("toxic").count().collect()}
    chosen = bounded_sample(named, "toxic", settings.per_label)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return written(rows.select("rn", "id", "toxic", "text"), "toxic-sample"), counts


def counted(rows: DataFrame) -> pa.Table:
    """(rn, id, toxic, terms, times) of the sample's rows, in the sample's order."""

    def run(batches):
        for batch in batches:
            found = [words(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([list(x) for x in found], pa.list_(pa.binary())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], ["rn", "id", "toxic", "terms", "times"])

    table = rows.mapInArrow(run, "rn int, id long, toxic int, terms array<binary>, times array<long>").toArrow()  # bounded by per_label
    return table.sort_by([("rn", "ascending"), ("toxic", "ascending"), ("id", "ascending")])


class Space:
    """The vector space: a number and a weight for every term of the sample."""

    def __init__(self, texts: list[list[bytes]], toxic: np.ndarray, floor: float):
        self.number: dict[bytes, int] = {}
        for terms in texts:
            for t in terms:
                self.number.setdefault(t, len(self.number))
        has, bad = np.zeros(len(self.number)), np.zeros(len(self.number))
        for terms, label in zip(texts, toxic, strict=True):
            at = np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms))
            has[at] += 1
            bad[at] += label
        rows, share = len(texts), toxic.mean()
        spread = np.sqrt(has * share * (1 - share) * (1 - has / (rows + 1)) + 1)
        self.weight = np.log((rows + 1) / (has + 1)) * (floor + np.abs(bad - has * share) / spread)

    def vector(self, terms: list[bytes], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers ascending, weights of length 1) of a text's terms; those the sample lacks have no dimension."""
        at = np.fromiter(map(self.number.get, terms, repeat(-1)), np.int64, len(terms))
        known = np.flatnonzero(at >= 0)
        known = known[np.argsort(at[known])]
        ids = at[known]
        weights = (1 + np.log(np.array(times, float)[known])) * self.weight[ids]
        length = np.sqrt((weights**2).sum())
        return (ids, weights / length) if length else (np.zeros(0, np.int64), np.zeros(0))


def _spread_out(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start at ``first`` and hold ``size``."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def alike(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, groups: int = 24, wide: int = 256) -> np.ndarray:
    """An order of the rows that puts alike ones side by side: by their nearest of some centres in the heaviest terms."""
    mass = np.zeros(terms)
    for ids, weights in vectors:
        mass[ids] += weights
    heavy = np.argsort(-mass, kind="stable")[:wide]
    place = np.full(terms, -1)
    place[heavy] = np.arange(len(heavy))
    x = np.zeros((len(vectors), len(heavy)))
    for row, (ids, weights) in enumerate(vectors):
        at = place[ids]
        x[row, at[at >= 0]] = weights[at >= 0]
    centres = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)].copy() if len(x) else x
    own = np.zeros(len(x), np.int64)
    for _ in range(6):
        own = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1) if len(x) else own
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = x[own == k].mean(0)
    return np.lexsort((np.arange(len(x)), own))


class BlockMaxIndex:
    """Postings by term and block of alike rows; a cell (term, block) knows the largest weight of its postings.

    The ``dense`` most frequent terms, of those that a sixteenth of the rows have, are columns of a matrix instead: their
    part of all similarities is one product for a batch of queries, and a block's bound holds it exactly.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int, dense: int = 256):
        self.rows, self.block = len(vectors), block
        self.blocks = max(1, -(-len(vectors) // block))
        self.order = order = alike(vectors, terms)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = np.concatenate([np.zeros(0, np.int64), *(v[0] for v in vectors)])
        at = np.repeat(place, [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([np.zeros(0), *(v[1] for v in vectors)])
        has = np.bincount(term, minlength=terms)
        often = np.argsort(-has, kind="stable")[:dense]
        often = often[16 * has[often] >= max(16, len(vectors))]
        self.column = np.full(terms, -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.rows))
        column = self.column[term]
        self.dense[column[column >= 0], at[column >= 0]] = weight[column >= 0]
        term, at, weight = term[column < 0], at[column < 0], weight[column < 0]
        by = np.lexsort((at, term))
        self.row, self.weight = at[by], weight[by]
        key = term[by] * self.blocks + at[by] // block
        self.first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, len(key)])
        self.most = np.maximum.reduceat(self.weight, self.first) if len(key) else np.zeros(0)
        self.place = key[self.first] % self.blocks
        self.cells = np.searchsorted(key[self.first] // self.blocks, np.arange(terms + 1))

    def frequent_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(queries, rows in blocks' order): what the terms of the matrix give to each similarity."""
        asked = np.zeros((len(queries), len(self.dense)))
        for n, (ids, weights) in enumerate(queries):
            column = self.column[ids]
            asked[n, column[column >= 0]] = weights[column >= 0]
        return asked @ self.dense

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the k nearest with a similarity above 0, nearest first, ties to smaller rows.

        ``part`` is the query's row of ``frequent_part``, where that is known.
        """
        if not len(ids) or not self.rows:
            return np.zeros(0, np.int64), np.zeros(0)
        sim = self.frequent_part([(ids, weights)])[0] if part is None else part.copy()
        many = self.cells[ids + 1] - self.cells[ids]
        cell, asked = _spread_out(self.cells[ids], many), np.repeat(weights, many)
        block = self.place[cell]
        bound = np.bincount(block, self.most[cell] * asked, self.blocks) + np.maximum.reduceat(sim, np.arange(0, self.rows, self.block))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        last = self.rows - min(k, self.rows)
        # What rows of blocks not yet read have so far only falls short, so the k-th best is never taken too high.
        done, step, best = 0, 3, np.partition(sim, last)[last]
        while done < len(order):
            # A bound within rounding of the k-th best may hold a tie, so it is still read.
            open_ = int((bound[order[done:]] >= best - 1e-9).sum())
            if not open_:
                break
            now = np.zeros(self.blocks, bool)
            now[order[done : done + min(step, open_)]] = True
            mine = np.flatnonzero(now[block])
            size = self.size[cell[mine]]
            at = _spread_out(self.first[cell[mine]], size)
            sim += np.bincount(self.row[at], self.weight[at] * np.repeat(asked[mine], size), self.rows)
            best = np.partition(sim, last)[last]
            done, step = done + min(step, open_), 4 * step
        found = np.flatnonzero((sim > 0) & (sim >= best - 1e-9))
        near, sim = self.order[found], sim[found]
        by = np.lexsort((near, -np.round(sim, 12)))[:k]
        return near[by], sim[by]


@dataclass
class Model:
    space: Space
    index: BlockMaxIndex
    toxic: np.ndarray
    ids: np.ndarray
    pull: np.ndarray  # per sample row, labelled rows it stands for
    fit: np.ndarray  # intercept, slope on the vote's log-odds, slope on the best similarity
    none: float
    k: int

    def vote(self, near: np.ndarray, sim: np.ndarray) -> float:
        w = self.pull[near] / (1.05 - np.minimum(sim, 1.0))
        return float((w * self.toxic[near]).sum() / w.sum())

    def probability(self, vote: float, best: float) -> float:
        z = self.fit @ _inputs(np.array([vote]), np.array([best]))[0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def scores(self, texts: list[str | None]):
        """(probability, nearest rows, their similarities) of each text."""
        for at in range(0, len(texts), 64):
            vectors = [self.space.vector(list(x), list(x.values())) for x in map(words, texts[at : at + 64])]
            for v, part in zip(vectors, self.index.frequent_part(vectors), strict=True):
                near, sim = self.index.nearest(*v, self.k, part)
                yield (self.probability(self.vote(near, sim), sim[0]) if len(near) else self.none), near, sim


def _inputs(vote: np.ndarray, best: np.ndarray) -> np.ndarray:
    v = np.clip(vote, 0.005, 0.995)
    return np.stack([np.ones(len(v)), np.log(v / (1 - v)), best * np.log(v / (1 - v))], 1)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | float:
    """A model from labelled rows, or the only rate there is."""
    rows, counts = sample(docs, labels, settings)
    table = counted(rows)
    toxic, ids = table.column("toxic").to_numpy().astype(float), table.column("id").to_numpy().astype(np.int64)
    sizes = {t: int((toxic == t).sum()) for t in (0, 1)}
    if not min(sizes.values()):
        return (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1) if counts else 0.0
    texts = table.column("terms").to_pylist()
    space = Space(texts, toxic, settings.floor)
    vectors = [space.vector(t, n) for t, n in zip(texts, table.column("times").to_pylist(), strict=True)]
    pull = np.array([counts[int(t)] / sizes[int(t)] for t in toxic])
    model = Model(space, BlockMaxIndex(vectors, len(space.number), settings.block), toxic, ids, pull, np.zeros(3), 0.0, settings.neighbours)
    vote, best, own, bare = [], [], [], []
    for i, v in enumerate(vectors):
        near, sim = model.index.nearest(*v, settings.neighbours + 1)
        keep = near != i
        near, sim = near[keep][: settings.neighbours], sim[keep][: settings.neighbours]
        if len(near):
            vote.append(model.vote(near, sim))
            best.append(sim[0])
            own.append(i)
        else:
            bare.append(i)
    model.none = float((pull[bare] * toxic[bare]).sum() + 0.5 * pull.mean() * toxic.mean()) / float(pull[bare].sum() + pull.mean())
    if own:
        x, y, w = _inputs(np.array(vote), np.array(best)), toxic[own], pull[own] / pull[own].sum()
        beta = np.zeros(3)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (w * (p - y)) + 1e-3 * beta
            h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(3)
            step = np.linalg.solve(h, g)
            beta -= step * min(1.0, 2 / (1e-9 + np.abs(step).max()))
        model.fit = beta
    return model


def score_documents(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, evidence (the three nearest: id, toxic, similarity)."""
    held = Held(docs.sparkSession, model)  # bounded by the sample and the space
    kind = "array<struct<id: bigint, toxic: int, similarity: double>>"

    def run(batches):
        own = held.value
        shape = pa.list_(pa.struct([("id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores, evidence = [], []
                texts = part.column(1).to_pylist()
                for p, near, sim in own.scores(texts) if isinstance(own, Model) else repeat((own, (), ()), len(texts)):
                    scores.append(p)
                    evidence.append([{"id": int(own.ids[i]), "toxic": int(own.toxic[i]), "similarity": float(s)} for i, s in zip(near[:3], sim[:3], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(evidence, shape)], ["id", "score", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, score double, evidence {kind}").withColumnRenamed("id", id_col)


def op6_toxicity(spark, sf_dir):
    from strictpast.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score_documents(docs, learn(docs, labels.where(crc32_of_id("doc_id") % 5 != 0)))
    return found.select("doc_id", (crc32_of_id("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
