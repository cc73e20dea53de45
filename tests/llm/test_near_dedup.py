"""The pipeline's near-dedup against brute force over exact shingle sets."""

import random

import numpy as np

import corpus_pipeline
from strictpast.llm import near_dedup, simhash


def slow_sets(rows):
    parts = {i: (t or "").encode().lower().split() for i, t in rows}
    return {i: {b" ".join(p[j : j + 5]) for j in range(max(1, len(p) - 4))} if p else set() for i, p in parts.items()}


def slow_kept(rows):
    sets = slow_sets(rows)
    ids, root = sorted(sets), {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * len(sets[a] | sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in ids if root[i] == i}


def test_stage_drops_all_similar_texts(spark):
    r = random.Random(4)
    rows = []
    for i in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 120, 400]))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, r.randrange(1, 5)):
            for _ in range(max(1, len(words) // 90)):
                words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
            rows.append((10 * i + j, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == slow_kept(rows) and len(kept) < len(rows)
    assert len(simhash.drop_near_copies(docs).collect()) > len(kept)  # what the stage left before
    assert corpus_pipeline.near(spark, docs.limit(0), "").count() == 0


def test_links_connect_as_all_pairs_do():
    r = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = r.integers(0, 10**9, 60).astype(np.uint64)
        for n in range(6):
            base = np.concatenate([base[4:], r.integers(0, 10**9, 4).astype(np.uint64)])  # a chain: neighbours are similar, ends are not
            sets.append(np.unique(base))
    sets = [sets[i] for i in r.permutation(len(sets))]
    links = near_dedup.similar_links(sets, 0.8)
    assert len(links) == 12 * 5 and len({root for _, root in links}) == 12


def test_crowded_groups_are_cut(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(60):  # near one another and mostly near the hub
        words = list(base)
        words[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(60, 90):  # a chain that leaves the first text step by step
        base = base[4:] + [f"y{i}_{j}" for j in range(4)]
        rows.append((i, " ".join(base)))
    rows += [(200 + i, "one two three four five six " + f"z{i} " * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {x.doc_id: x.component_id for x in near_dedup.near_components(docs).collect()}
    assert {i for i, c in whole.items() if i == c} == slow_kept(rows)
    for room in (150, 2000):
        assert {x.doc_id: x.component_id for x in near_dedup.near_components(docs, room=room).collect()} == whole


def test_candidates_are_simhash_blocks(spark):
    r = random.Random(12)
    sets, pairs = [], []
    for n in range(120):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 40, 300]))]
        sets.append(near_dedup.shingles(" ".join(words).encode()))
        words[r.randrange(4)] = "other" if len(words) > 8 else words[0]
        sets.append(near_dedup.shingles(" ".join(words).encode()))
    prints = near_dedup.fingerprints(sets)
    for x, p in zip(sets[:4], prints[:4], strict=True):  # whatever else is in the batch
        assert (near_dedup.fingerprints([x])[0] == p).all()
    rows = [(n, p.tobytes()) for n, p in enumerate(prints)]
    single = spark.createDataFrame(rows, "digest long, print binary").repartition(3)
    groups = {}
    for x in near_dedup.candidates(single).collect():
        groups.setdefault(x.key, set()).add(x.digest)
    assert all(len(g) > 1 for g in groups.values())
    found = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    for a in range(240):
        for b in range(a + 1, 240):
            both = len(np.intersect1d(sets[a], sets[b]))
            if not np.array_equal(sets[a], sets[b]) and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    assert len(pairs) > 50 and found >= set(pairs) and len(found) < 2 * len(pairs) + 100
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, 40)
    crowd = {}
    for x in near_dedup.candidates(single, 1).collect():  # keys that go over the end of a batch have too many rows
        crowd.setdefault(x.key, set()).add(x.digest)
    spark.conf.set(name, old)
    assert sum(map(len, crowd.values())) > sum(map(len, groups.values()))
    assert {(a, b) for g in crowd.values() for a in g for b in g if a < b} >= found


def test_close_groups_of_small_and_large_buckets():
    r = np.random.default_rng(3)
    key = np.sort(r.integers(0, 40, 3000))
    sketch = r.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    sketch[1::3] = sketch[::3] ^ np.uint64(0b10110001)
    small, large = near_dedup.close_groups(key, sketch), near_dedup.close_groups(key, sketch, 10)
    assert (small == large).all() and (key[small] == key).all()
    together = small[1::3] == small[::3]
    assert (together == (key[1::3] == key[::3])).all() and (np.bincount(small) > 1).sum() > 0.99 * together.sum()
