"""SimHash near-duplicates: pigeonhole blocks find candidates, exact Hamming distances verify them.

A text's fingerprint takes the majority of each bit over the XXH64 of its word shingles. Texts are ASCII-lower-cased
and split at ASCII white space; repeated shingles count each, a text of fewer words is one shingle, a text without
words (null and empty too) has fingerprint zero and links like any other. Fingerprints at ``distance`` or fewer
differing bits link, and a component's id is the smallest id reachable. Repeated rows share a fingerprint and so a
component. A null id takes part in linking but is never a component's id unless all its ids are null. An empty table
gives an empty result. Only the id and the text are read, so other columns may have any name.

Equal fingerprints collapse to one before any join, so copies cost nothing. The 64 bits are cut into ``distance + 2``
blocks: two fingerprints at ``distance`` differ in at most ``distance`` blocks and agree in two, so each pair of
blocks makes a key. Keys of up to ``BUCKET`` fingerprints are verified in memory, and a spanning forest of their links
goes on, not all pairs. Larger buckets take an exact way of linear size: two fingerprints within 4 bits share a point
within 2 bits of both, and any two that share such a point are within 4.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import unwrapped, wrapped, written
from strictpast.llm.components import components

BUCKET = 8192


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one whole text."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, seed) for x in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` blocks that cover 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _keys(distance: int):
    """One array column: a 64-bit key for each pair of blocks, all that agrees put side by side under the pair's number."""
    out = []
    for number, ((s1, w1), (s2, w2)) in enumerate(combinations(_blocks(distance + 2), 2)):
        one = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << w1) - 1))
        two = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1))
        out.append(F.shiftleft(F.lit(number).cast("long"), w1 + w2).bitwiseOR(F.shiftleft(one, w2)).bitwiseOR(two) + F.lit(number << 40))
    return F.array(*out)


def spanning_links(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links that connect ``values`` just as all pairs within ``distance`` would."""
    left = np.sort(values)
    members, roots = [], []
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 64):
                near |= (np.bitwise_count(frontier[at : at + 64, None] ^ left[None, :]) <= distance).any(0)
            frontier, left = left[near], left[~near]
            members.append(frontier)
            roots.append(np.full(len(frontier), root))
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *members]), np.concatenate([empty, *roots])


def links(distinct: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp) whose components are those of all pairs within ``distance``."""
    if not 1 <= distance <= 4:
        raise ValueError("distance must be 1 to 4")
    keyed = distinct.select(F.explode(_keys(distance)).alias("key"), "fp")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(shared.hint("merge"), "key")  # merged, as are all joins here: a broadcast of what grows with the input fills the driver

    def verify(batches):
        for batch in batches:
            a, b = [], []
            for group in batch.column(0).to_pylist():
                found = spanning_links(np.array(group, np.int64).view(np.uint64), distance)
                a.append(found[0])
                b.append(found[1])
            a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    small = members.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("group")).select("group").mapInArrow(verify, "a long, b long")
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    # Of two fingerprints within ``distance``, one is within ``near`` bits of a point and the other within ``reach``.
    near, reach = distance // 2, distance - distance // 2
    flips = [x for x in (0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))) if x.bit_count() <= reach]
    masks = F.array(*[F.lit(int(np.uint64(x).view(np.int64))) for x in flips])
    points = crowded.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= near).alias("close"))
    hubs = points.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("b"), F.count("*").alias("n")).where("n > 1 and b is not null").select("point", "b")
    far = points.join(hubs.hint("merge"), "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return small.unionByName(far).distinct()


def near_components(docs: DataFrame, distance: int = 4, words: int = 4, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp (signed long), component_id."""
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), distance, bucket))
    labelled = least.join(roots.hint("merge"), least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    final = labelled.select("fp", "root").join(whole.hint("merge"), "root").select("fp", "component_id")
    return prints.join(final.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's id, once each, with all their columns.

    Rows with a null id can't be told apart and all stay.
    """
    found = near_components(docs, distance, words, BUCKET, id_col, text_col)
    return keep_representatives(docs, found.select(F.col(id_col).alias("id"), "component_id"), id_col)


def keep_representatives(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row of ``docs`` for each component of ``found`` (id, component_id), and all rows with a null id."""
    stay = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("stay")).distinct()
    rows = wrapped(docs, key=F.col(id_col).cast("long"))
    # Joined and freed of repeated rows under one partitioning by id, so a text moves once.
    kept = rows.where("key is not null").join(stay.hint("merge"), F.col("key") == F.col("stay")).dropDuplicates(["key"]).select("row")
    return unwrapped(kept.unionByName(rows.where("key is null").select("row")), docs.columns)


def op4_simhash(spark, sf_dir):
    from strictpast.llm.common import table

    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
