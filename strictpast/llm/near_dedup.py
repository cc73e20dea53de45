"""Near-duplicate removal: SimHash blocks find candidates, the Jaccard similarity of exact word shingles verifies them.

A text's set holds the XXH64 of its shingles of ``words`` words, ASCII-lower-cased and split at ASCII white space; a text
of fewer words is one shingle, a text without words (null and empty too) has the empty set and links to others such.
Sets of a similarity of ``least`` or more link, and of each component the row with the smallest id stays.

Equal sets collapse to one before any join. A shingle's code is a row of random signs, chosen and signed by its hash; a
fingerprint bit is set where the codes of a set sum to more than zero. ``BLOCKS`` blocks of ``WIDE`` bits are join keys, and
of the sets that share a key those within ``REACH`` of ``SKETCH`` further bits, directly or through others, are verified
together, by a spanning forest of their links and not all pairs; equal groups are verified once. Sets at similarity 0.8
differ in 0.15 of the bits (0.19, if they hold four and five shingles), so such a pair shares no block with a chance of
10^-4 (0.007), and more similar pairs with less. A group of more than ``ROOM`` hashes is compared with one hub, row by
row, and only what is not near the hub is compared with the rest, in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import Held, frugal, once_a_process, written
from strictpast.llm.components import components
from strictpast.llm.simhash import keep_representatives

BLOCKS, WIDE = 72, 13
SKETCH, REACH = 128, 40
_CELLS = 1024
#: Rows that share a key and are compared by their sketches; more go on as one group.
CROWD = 1 << 20

_SLOTS = 1 << 23
#: Hashes of a group that one task verifies, 8 MB; larger groups are cut.
ROOM = 1 << 20


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes of one whole text, ascending."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    found = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in found], np.uint64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, bytes): the SimHash of each set, all blocks and then the sketch."""
    bits = BLOCKS * WIDE + SKETCH
    codes = once_a_process("simhash codes", lambda: (np.random.default_rng(17).integers(0, 2, (_CELLS, bits)) * 2 - 1).astype(np.float32))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    sign = (flat >> np.uint64(10) & np.uint64(1)).astype(float) * 2 - 1
    sums = np.bincount(owner * _CELLS + (flat % np.uint64(_CELLS)).astype(np.int64), sign, len(sets) * _CELLS)
    # Sums of whole numbers, so exact in any order.
    return np.packbits(sums.reshape(-1, _CELLS).astype(np.float32) @ codes > 0, axis=1)


def block_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, BLOCKS) keys that name the block and hold its bits, and (sets, 2) words of the sketch."""
    bits = np.unpackbits(prints, axis=1, count=BLOCKS * WIDE + SKETCH)
    blocks = bits[:, : BLOCKS * WIDE].reshape(-1, BLOCKS, WIDE) @ (1 << np.arange(WIDE))
    return (np.arange(BLOCKS) << WIDE) + blocks, np.packbits(bits[:, BLOCKS * WIDE :], axis=1).view(np.uint64)


def close_groups(key: np.ndarray, sketch: np.ndarray, sweep: int = 4096) -> np.ndarray:
    """For rows in the order of their keys: the first row of those of the same key that are close, directly or through others."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    root = np.arange(len(key))
    far = np.repeat(starts + size, size)
    at, step, left, right = np.flatnonzero(np.repeat(size <= sweep, size)), 1, [], []
    while len(at):  # all pairs of the buckets at once, by how far apart they stand
        at = at[at + step < far[at]]
        near = at[np.bitwise_count(sketch[at] ^ sketch[at + step]).sum(1) <= REACH]
        left.append(near)
        right.append(near + step)
        step += 1
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    while len(left):
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        apart = root[left] != root[right]
        if not apart.any():
            break
    for first, n in zip(starts[size > sweep].tolist(), size[size > sweep].tolist(), strict=True):
        rest = np.arange(first, first + n)
        while len(rest):
            top, wave, rest = rest[0], rest[:1], rest[1:]
            while len(wave) and len(rest):
                near = np.zeros(len(rest), bool)
                for i in wave:
                    near |= np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1) <= REACH
                    if near.all():
                        break
                wave, rest = rest[near], rest[~near]
                root[wave] = top
    return root


def candidates(single: DataFrame, most: int = CROWD) -> DataFrame:
    """(key, digest) of groups of two or more of ``single`` (digest, print) that share a block and are close.

    More than ``most`` rows with one key are one group, close or not, and are held by no task.
    """

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys, sketch = block_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1))
                digest = np.repeat(part.column(0).to_numpy(), BLOCKS)
                one, two = (np.repeat(x, BLOCKS).view(np.int64) for x in sketch.T)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel().astype(np.int32), digest, one, two)], ["block", "digest", "one", "two"])

    def group(batches):
        held, crowd = [], None  # the rows of the last key so far; the key whose rows are too many

        def out():
            key, digest, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            root = close_groups(key, np.stack([one, two], 1).view(np.uint64))  # of signed numbers bits are counted without sign
            many = np.bincount(root, minlength=len(root))[root] > 1
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            inside = root - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
            yield pa.RecordBatch.from_arrays([pa.array((key[many].astype(np.int64) << 32) + inside[many]), pa.array(digest[many])], ["key", "digest"])

        def whole(key, digest):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(digest), int(key) << 32)), pa.array(digest)], ["key", "digest"])

        for batch in batches:
            part = [x.to_numpy() for x in batch.columns]
            while len(part[0]):
                if crowd is not None:  # what is left of it passes through
                    n = int(np.searchsorted(part[0], crowd, "right"))
                    yield whole(crowd, part[1][:n])
                    part = [x[n:] for x in part]
                    crowd = crowd if not len(part[0]) else None
                    continue
                last = part[0][-1]
                cut = int(np.searchsorted(part[0], last))
                if cut:
                    held.append([x[:cut] for x in part])
                if held and held[-1][0][-1] != last:
                    yield from out()
                held.append([x[cut:] for x in part])
                if sum(len(x[0]) for x in held) > most:
                    crowd = last
                    for x in held:
                        yield whole(crowd, x[1])
                    held.clear()
                break
        if held:
            yield from out()

    dealt = single.select("digest", "print").mapInArrow(frugal(spread), "block int, digest long, one long, two long").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(frugal(group), "key long, digest long")


def digests(sets: list[bytes]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(x, 7) for x in sets], np.uint64).view(np.int64))


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(member, root) positions that connect ``sets`` just as all pairs of similarity ``least`` would."""
    sizes = np.array([len(x) for x in sets])
    left, out = np.arange(len(sets)), []
    while len(left):
        root, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            flat, owner = np.concatenate([sets[i] for i in left]), np.repeat(np.arange(len(left)), sizes[left])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            near = np.zeros(len(left), bool)
            for i in wave:
                first, last = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], "right")
                n = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(left))
                near |= both >= least * (sizes[left] + sizes[i] - both) - 1e-9
                if near.all():
                    break
            wave, left = left[near], left[~near]
            out += [(int(i), int(root)) for i in wave]
    return out


def _links(df: DataFrame, least: float) -> DataFrame:
    """(a, b) over rows with an array ``group`` of (digest, hashes): links that connect it as all similar pairs would."""

    def verify(batches):
        for batch in batches:
            a, b = [], []
            for group in batch.column(0).to_pylist():
                for i, root in similar_links([np.frombuffer(x["hashes"], np.uint64) for x in group], least):
                    a.append(group[i]["digest"])
                    b.append(group[root]["digest"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return df.select("group").mapInArrow(frugal(verify), "a long, b long")


def _near_hub(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(digest, hub) of those ``pairs`` whose sets are similar."""

    def verify(batches):
        for batch in batches:
            near = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["digest", "hub"]).filter(pa.array(near, pa.bool_()))

    hubs = sets.select(F.col("digest").alias("hub"), F.col("hashes").alias("hub_hashes"))
    return pairs.join(sets, "digest").join(hubs, "hub").select("digest", "hub", "hashes", "hub_hashes").mapInArrow(verify, "digest long, hub long")


def _crowded_links(members: DataFrame, sets: DataFrame, least: float, room: int) -> DataFrame:
    """Links within groups (key, digest, size) too large for a task.

    All members are compared with the group's hub, its smallest digest, row by row. Those near it are connected through
    it and need no more of each other; the others are compared with every member. Both sides are cut into chunks of
    about ``room`` hashes, and a task takes two chunks, so it holds no more however large the group is.
    """
    hubs = members.groupBy("key").agg(F.min("digest").alias("hub"))
    asked = members.join(hubs, "key")
    near = written(_near_hub(asked.where("digest <> hub").select("digest", "hub").distinct(), sets, least), "near-hub")
    marked = asked.join(near.withColumn("near", F.lit(True)), ["digest", "hub"], "left")
    marked = written(marked.select("key", "digest", "size", (F.coalesce("near", F.lit(False)) | (F.col("digest") == F.col("hub"))).alias("near")), "marked")
    chunks = lambda near_: F.ceil(F.sum(F.when(F.col("near") == near_, F.col("size")).otherwise(0)) / F.lit(room)).cast("int")
    cuts = marked.groupBy("key").agg(chunks(False).alias("apart"), chunks(True).alias("close")).where("apart > 0")
    own = marked.join(cuts, "key").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.when(F.col("near"), F.col("close")).otherwise(F.col("apart"))).cast("int"))
    each, other = F.sequence(F.lit(0), F.col("apart") - 1), F.sequence(F.lit(0), F.col("apart") + F.col("close") - 1)
    units = F.when(F.col("near"), F.transform(each, lambda i: F.struct(i.alias("i"), (F.col("apart") + F.col("chunk")).alias("j"))))
    units = units.otherwise(F.transform(other, lambda j: F.struct(F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j"))))
    dealt = own.select("key", "digest", F.explode(units).alias("unit")).join(sets, "digest")
    groups = dealt.groupBy("key", "unit").agg(F.collect_list(F.struct("digest", "hashes")).alias("group"))
    return _links(groups, least).unionByName(near.select(F.col("digest").alias("a"), F.col("hub").alias("b")))


def near_components(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """Per row: id, component_id. Rows with a null id link only to equal sets."""

    def prints(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [shingles(x, words) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), digests([x.tobytes() for x in found]), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in fingerprints(found)], pa.binary())], ["id", "digest", "size", "print"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = written(rows.mapInArrow(frugal(prints, "simhash codes"), "id long, digest long, size long, print binary"), "prints")
    # Copies collapse before the keys are spread, so a text that a third of all rows carry is one member.
    single = written(found.where("id is not null and size > 0").dropDuplicates(["digest"]).select("digest", "size", "print"), "single")
    keyed = written(candidates(single).join(single.select("digest", "size"), "digest"), "keyed")
    members = keyed.join(keyed.groupBy("key").agg(F.sum("size").alias("whole")), "key")
    few = members.where(F.col("whole") <= room).groupBy("key").agg(F.sort_array(F.collect_set("digest")).alias("members")).select("members").distinct()
    few = written(few.withColumn("number", F.monotonically_increasing_id()), "groups").select("number", F.explode("members").alias("digest"))
    many = members.where(F.col("whole") > room).select("key", "digest", "size")
    # Only candidates' texts are read again. A bitmap of fixed size, over their ids' hashes, drops the others before the
    # join; the join decides, so a bitmap that fills up costs time but changes nothing.
    wanted = written(members.select("digest").distinct().join(found.select("id", "digest"), "digest").groupBy("digest").agg(F.min("id").alias("id")).where("id is not null"), "wanted")
    slot = F.pmod(F.xxhash64("id"), F.lit(_SLOTS)).cast("int").alias("slot")
    place = slot + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(place)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place))).collect()  # 1 MB in all
    marks = np.zeros((_SLOTS // 32768, 4096), np.uint8)
    for bucket, body in bits:
        marks[bucket - 1] = np.frombuffer(body, np.uint8)
    held = Held(docs.sparkSession, marks)

    def read_again(batches):
        marked = np.unpackbits(held.value, bitorder="little").astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marked[batch.column(2).to_numpy()]))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                again = [shingles(x, words).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), digests(again), pa.array(again, pa.binary())], ["id", "digest", "hashes"])

    again = rows.where("id is not null").select("id", "text", slot).mapInArrow(frugal(read_again), "id long, digest long, hashes binary")
    # Rows that share an id may differ, so the digest is part of the match.
    sets = written(again.join(wanted, ["id", "digest"]).select("digest", "hashes").dropDuplicates(["digest"]), "sets")
    links = _links(few.join(sets, "digest").groupBy("number").agg(F.collect_list(F.struct("digest", "hashes")).alias("group")), least)
    if not many.isEmpty():
        links = links.unionByName(_crowded_links(many, sets, least, room))
    roots = components(links.distinct())
    smallest = found.groupBy("digest").agg(F.min("id").alias("smallest"))
    labelled = written(smallest.join(roots, smallest.digest == roots.node, "left").select("digest", "smallest", F.coalesce("root", "digest").alias("root")), "labelled")
    whole = labelled.groupBy("root").agg(F.min("smallest").alias("component_id"))
    final = labelled.join(whole, "root").select("digest", "component_id")
    return found.select("id", "digest").join(final, "digest").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's id, once each, with all their columns.

    Rows with a null id can't be told apart and all stay.
    """
    found = near_components(docs, least, words, id_col, text_col)
    return keep_representatives(docs, found.select(F.col(id_col).alias("id"), "component_id"), id_col)
