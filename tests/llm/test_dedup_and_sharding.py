import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strictpast.llm import exact_dedup, sharding, simhash
from strictpast.llm.components import components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_against_brute_force(corpus):
    rows, df = corpus
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    found = exact_dedup.exact_dedup(df).collect()
    assert len(found) == len(rows)
    expected = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    first = {}
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        first.setdefault(norm(t), (i, t))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == sorted(x for x in first.values() if x[1] is not None)
    assert kept.count() == len(first)


def test_exact_dedup_hash_collisions_are_split(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    rows, df = corpus
    found = exact_dedup.exact_dedup(df).collect()
    sizes = defaultdict(int)
    for _, t, *_ in rows:
        sizes[norm(t)] += 1
    texts = dict((i, t) for i, t, *_ in rows)
    assert all(r.group_size == sizes[norm(texts[r.doc_id])] for r in found) and len(found) == len(rows)


def test_exact_dedup_edges(spark, nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_exact_copies(nothing).count() == 0
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (5, None), (4, "")], "doc_id long, text string")
    found = {(r.doc_id, r.text_sha256): r.kept for r in exact_dedup.exact_dedup(df).collect()}
    a, b, e = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b""))
    assert found == {(None, a): False, (3, a): True, (None, b): True, (5, e): False, (4, e): True}
    assert {(r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(df).collect()} == {(3, "a"), (None, "b"), (4, "")}


def slow_print(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > len(h))


def brute_components(prints, ids, distance=4):
    label = dict(zip(ids, ids))
    near = [[j for j, b in zip(ids, prints) if (a ^ b).bit_count() <= distance] for a in prints]
    changed = True
    while changed:
        changed = False
        for i, links in zip(ids, near):
            low = min(label[j] for j in links)
            if low < label[i]:
                label[i] = low
                changed = True
    return label


def test_simhash_against_brute_force(corpus):
    rows, df = corpus
    found = {r.doc_id: r for r in simhash.near_components(df).collect()}
    unique = {i: t for i, t, *_ in rows}
    prints = {i: slow_print(t) for i, t in unique.items() if len(t or "") < 50_000}
    assert all(found[i].fp & (2**64 - 1) == p for i, p in prints.items())
    whole = [found[i].fp & (2**64 - 1) for i in unique]
    label = brute_components(whole, list(unique))
    assert {i: found[i].component_id for i in unique} == label
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_simhash_random_prints_and_crowded_buckets(spark, rng):
    center = rng.integers(0, 2**63, 6).astype(np.uint64)
    prints = set()
    for c in center:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    for distance in (1, 2, 3, 4):
        label = brute_components(prints, prints, distance)
        for bucket in (simhash.BUCKET, 2):
            links = simhash.links(df, distance, bucket)
            root = {r.node: r.root for r in components(links).collect()}
            mine = defaultdict(set)
            for x in prints:
                s = int(np.uint64(x).view(np.int64))
                mine[root.get(s, s)].add(x)
            expected = defaultdict(set)
            for x in prints:
                expected[label[x]].add(x)
            assert sorted(map(sorted, mine.values())) == sorted(map(sorted, expected.values())), (distance, bucket)


def test_simhash_edges(spark, nothing):
    assert simhash.near_components(nothing).count() == 0 and simhash.drop_near_copies(nothing).count() == 0
    df = spark.createDataFrame([(None, "one two three four five"), (7, "ONE two\tthree four five"), (9, None), (8, "")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    assert found == {None: 7, 7: 7, 9: 8, 8: 8}
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == {None, 7, 8}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(1000, 1300)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 5 for i in range(1000, 1300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_shards(sizes, limit):
    """Leaves of a directory that splits oversized buckets bit by bit; rows (code, bytes)."""
    out, todo = {}, [(0, 0, sizes)]
    while todo:
        depth, prefix, rows = todo.pop()
        if sum(b for _, b in rows) <= limit or len(rows) == 1 or depth == sharding.BITS:
            out[(depth, prefix)] = rows
            continue
        for bit in (0, 1):
            part = [x for x in rows if x[0] >> (sharding.BITS - depth - 1) & 1 == bit]
            if part:
                todo.append((depth + 1, prefix * 2 + bit, part))
    return out


def test_sharding_against_brute_force(corpus):
    rows, df = corpus
    for limit in (1500, 20_000, 10**9):
        found = sharding.shard(df, limit).collect()
        assert len(found) == len(rows)
        sizes = defaultdict(int)
        keyed = {}
        for i, t, *_ in rows:
            code = int(hashlib.md5(f"{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
            keyed.setdefault((code, i), [0, len((t or "").encode())])[0] += 1
        leaves = slow_shards([(c, n * b) for (c, _), (n, b) in keyed.items()], limit)
        depth = {}
        for (d, p), part in leaves.items():
            for c, _ in part:
                depth[c] = (d, p)
        for r in found:
            sizes[r.shard] += r.bytes
        code = {i: c for c, i in keyed}
        for r in found:
            d, p = depth[code[r.doc_id]]
            name = "b" + (format(p, f"0{d}b") if d else "")
            assert r.shard.split(".")[0] == name and r.depth == d
            assert sizes[r.shard] <= limit or r.oversized


def test_sharding_copies_fill_pages(spark, nothing):
    df = spark.createDataFrame([(1, "x" * 10)] * 25 + [(None, None)] * 3 + [(2, "y" * 500)], "doc_id long, text string")
    found = sharding.shard(df, 100).collect()
    per = defaultdict(int)
    for r in found:
        if r.doc_id == 1:
            per[r.shard] += 1
    assert sum(per.values()) == 25 and max(per.values()) == 10 and len(per) == 3
    assert sum(r.doc_id is None for r in found) == 3 and [r.oversized for r in found if r.doc_id == 2] == [True]
    assert sharding.shard(nothing, 100).count() == 0


def test_simhash_broadcasts_nothing(corpus):
    _, df = corpus
    for found in (simhash.near_components(df), simhash.drop_near_copies(df), simhash.links(df.select(F.col("doc_id").alias("fp")).distinct())):
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
