import math
import os
import random
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strictpast.llm import ann, html_extract, langid, maxent_lm, toxicity
from strictpast.llm.common import bounded_sample, scratch, written

# neighbours


def test_search_against_brute_force(spark, rng):
    x = rng.normal(size=(600, 16)).astype("float32")
    x[100:180] = x[7]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (701, [0.0] * 16), (702, [1.0] * 15 + [float("nan")]), (703, [1.0] * 15 + [None]), (704, [1.0, 2.0]), (None, [1.0] * 16), (705, [1.0] * 15 + [float("inf")])]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "vec_id long, embedding array<float>, score string")
    found = ann.search(df, F.col("id") % 20 == 0, 10).toPandas()
    d = x.astype(float)
    hit = 0
    for q in range(0, 600, 20):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(600), dist))[:10]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        np.testing.assert_allclose(mine["score"], dist[mine["vec_id"].to_numpy()])
        hit += len(set(mine["vec_id"]) & set(best))
        assert list(zip(mine["score"], mine["vec_id"])) == sorted(zip(mine["score"], mine["vec_id"]))
    assert hit / 300 >= 0.9
    assert set(found["query_id"]) == set(range(0, 600, 20))


def test_search_small_tables_and_parts(spark, rng, monkeypatch):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    found = ann.search(few, F.col("id") == 0, 10).toPandas()
    assert found["vec_id"].tolist() == [1, 2, 3]
    assert ann.search(few.limit(0), F.col("id") == 0).count() == 0
    monkeypatch.setattr(ann, "PART", 30)
    monkeypatch.setattr(ann, "BLOCK", 3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    a = ann.search(df, F.col("id") % 10 == 0).toPandas()
    assert len(a) == 300 and not a.duplicated(["query_id", "vec_id"]).any()


def test_recall_of_the_registered_table(spark):
    found = ann.op1_ann(spark, "/root/testdata/sf0.1").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r[0], r[1]) for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        mine = found[found["query_id"] == ids[q]].sort_values("rank")["vec_id"].tolist()
        hit += len(set(mine) & set(ids[np.lexsort((ids, distance))[:10]]))
        total += 10
    assert hit / total >= 0.95


def test_clustered_vectors_need_few_cells(rng):
    centres = rng.normal(size=(100, 32)) * 20
    x = centres[rng.integers(0, 100, 5000)] + rng.normal(size=(5000, 32))
    c = ann.kmeans(x, 35, 1)
    assert ann.probes_for(x, c, ann.Settings(probes=1)) <= 3
    assert ann.probes_for(rng.normal(size=(5000, 32)), c, ann.Settings()) >= 12
    assert ann.probes_for(x[:1], x[:1], ann.Settings(probes=1)) == 1


def test_repeated_vector_ids(spark, rng):
    rows = [(i % 40, rng.normal(size=6).tolist()) for i in range(80)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, 5).toPandas()
    assert sorted(found["query_id"].unique()) == [0, 10, 20, 30] and (found["query_id"] != found["vec_id"]).all()
    assert all(sorted(g["rank"]) == [1, 2, 3, 4, 5] for _, g in found.groupby("query_id"))
    least = {q: min(v for i, v in rows if i == q) for q in (0, 10, 20, 30)}  # of vectors that share an id the smallest asks
    for r in found.itertuples():
        assert any(r.score == pytest.approx(math.dist(least[r.query_id], v)) for i, v in rows if i == r.vec_id)


# languages


def test_language_gradient_is_right():
    net = langid.Network(3, 4, 1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    data, labels, weights = r.integers(0, 256, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones((5, 6), np.float32)
    _, g = net.gradient(data, labels, weights)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-2
        up = net.gradient(data, labels, weights)[0]
        net.p[k][at] -= 2e-2
        down = net.gradient(data, labels, weights)[0]
        net.p[k][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[k][at], rel=0.02, abs=1e-4), k


def test_language_id(corpus, nothing):
    rows, df = corpus
    settings = langid.Settings(epochs=12, batch=32)
    model = langid.learned(df, settings)
    assert model.langs == ["de", "en", "fr"]
    found = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [(i, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 3 == 1 and t and 10 < len(t) < 5000]
    assert np.mean([found[i].lang_pred == lang for i, lang in held]) > 0.9
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (400, 401, 402, 403))
    assert all(0 <= r.score <= 1 for r in found.values()) and len(langid.predict(df, model).collect()) == len(rows)
    kept = langid.keep_identified(df, settings)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {400, 401, 402, 403}
    assert langid.predict(nothing, langid.learned(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.fit([])).collect()} == {"und"}


def test_chunks_agree_with_one_reading():
    r = np.random.default_rng(1)
    model = langid.Model(["a", "b"], langid.Network(2, 8, 3), langid.Settings(chunk=64, context=32))
    text = bytes(r.integers(97, 123, 500).astype(np.uint8))
    whole = model.network.soft(model.network.logits(np.frombuffer(text, np.uint8)[None])).mean((0, 1))
    np.testing.assert_allclose(model.probabilities([text, b""])[0], whole, atol=0.02)
    assert (model.probabilities([b""])[0] == 0).all()


def test_scores_depend_on_the_text_alone(corpus):
    rows, df = corpus
    model = langid.Model(["a", "b", "c"], langid.Network(3, 16, 3), langid.Settings(lanes=64))
    texts = [t.encode() for _, t, *_ in rows if t and len(t) < 5000]
    apart = np.concatenate([model.probabilities([t]) for t in texts])
    np.testing.assert_allclose(model.probabilities(texts), apart, atol=1e-6, rtol=0)
    np.testing.assert_allclose(model.probabilities(texts[::-1])[::-1], apart, atol=1e-6, rtol=0)
    one, two = ({r.doc_id: r.score for r in langid.predict(df.repartition(n), model).collect()} for n in (2, 13))
    assert max(abs(one[i] - two[i]) for i in one) < 1e-6


def test_null_ids_and_more_languages_than_are_learned(spark):
    model = langid.Model(["a", "b"], langid.Network(2, 8, 3), langid.Settings())
    found = langid.predict(spark.createDataFrame([(None, "some text"), (None, None), (1, "some text")], "doc_id long, text string"), model).collect()
    assert len(found) == 3 and len({r.score for r in found if r.lang_pred != "und"}) == 1 and sum(r.doc_id is None for r in found) == 2
    rows = spark.createDataFrame([(i, f"l{i % 5}") for i in range(30)], "id long, lang string")
    with pytest.warns(UserWarning, match="3 largest"):
        some = bounded_sample(rows, "lang", 4, most_groups=3)
    assert some.groupBy("lang").count().collect() and {r["count"] for r in some.groupBy("lang").count().collect()} == {4} and some.count() == 12


def test_short_lanes_beside_long_ones_are_read_from_their_own_ends():
    net, r = langid.Network(3, 16, 5), np.random.default_rng(2)
    net.p["c"] += r.normal(size=net.p["c"].shape).astype(np.float32)
    lengths = np.array([1, 2, 40, 7, 40])
    data = r.integers(0, 256, (5, 40)).astype(np.uint8)  # bytes after a lane's end must not matter
    found = net.logits(data, lengths)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for lane, n in enumerate(lengths):
        want = np.tile(p["b"], (n, 1))
        for k, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
            state = np.zeros(16)
            for t in order:
                pre, own = np.split(p["E"][k, data[lane, t]], 3), np.split(state @ p["U"][k], 3)
                update, reset = (1 / (1 + np.exp(-pre[g] - own[g])) for g in (0, 1))
                fresh = np.tanh(pre[2] + reset * (own[2] + p["c"][k, 0]))
                state = fresh + update * (state - fresh)
                want[t] += state @ p["V"][k]
        np.testing.assert_allclose(found[:n, lane], want, atol=1e-5)


def test_reading_costs_little_more_than_its_exponentials():
    """Of the time, what the 96 exponentials a byte take is the yardstick, so that the machine's pace doesn't count."""
    code = """
import time, numpy as np
from strictpast.llm import langid
r = np.random.default_rng(1)
model = langid.Model(list("abcd"), langid.Network(4, 16, 3), langid.Settings())
texts = [bytes(r.integers(97, 123, 1000).astype(np.uint8)) for _ in range(384)]
gates, fresh = r.normal(size=(4, 16, 1536)).astype(np.float32), r.normal(size=(2, 16, 1536)).astype(np.float32)
def exponentials():
    a, b = np.empty_like(gates), np.empty_like(fresh)
    for _ in range(250):
        np.exp(gates, out=a), np.exp(fresh, out=b)
def took(f):
    start = time.process_time()
    f()
    return time.process_time() - start
pairs = [(took(lambda: model.probabilities(texts)), took(exponentials)) for _ in range(5)]
print(min(a for a, _ in pairs) / min(b for _, b in pairs))
"""
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join(sys.path)}
    ratio = float(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout)
    assert ratio < 4  # 2.9 here; 4.7 to 4.9 with gates across lanes and a softmax over the last axis


def test_gradient_of_short_windows_is_right():
    net = langid.Network(3, 4, 1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    data, labels = r.integers(1, 256, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    weights = (np.arange(6) < np.array([6, 3, 1, 4, 6])[:, None]).astype(np.float32)
    data[weights == 0] = 0
    _, g = net.gradient(data, labels, weights)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        net.p[k][at] += 1e-4
        up = net.gradient(data, labels, weights)[0]
        net.p[k][at] -= 2e-4
        down = net.gradient(data, labels, weights)[0]
        net.p[k][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=0.02, abs=1e-5), k


# language model

SMALL = maxent_lm.Settings(classes=4, members=8, buckets=4, listed=60, hashed=256, share=4, learner_tokens=3000, batch=512)


def test_base_scores_are_exact(corpus, nothing):
    rows, df = corpus
    rule = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 1
    found = maxent_lm.score_documents(df, rule, SMALL).toPandas()
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t, *_ in rows}
    counts = Counter()
    for i, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found.itertuples():
        w = tokens[r.doc_id]
        assert r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    held = found[~found["train"]]
    assert held["score"].sum() > held["base_score"].sum() and (found["score"] < 0).all()
    assert maxent_lm.score_documents(nothing, rule, SMALL).count() == 0
    untrained = maxent_lm.score_documents(df.limit(5), F.lit(False), SMALL).toPandas()
    assert (untrained["score"] == 0).all() and (untrained["base_score"] == 0).all()


def test_probabilities_sum_to_one():
    s = SMALL
    counts = np.arange(40, 0, -1)
    words = [f"w{i}".encode() for i in range(40)]
    sums, once = np.zeros(s.buckets), np.zeros(s.buckets)
    for w, c in zip(words[s.frequent :], counts[s.frequent :], strict=True):
        sums[maxent_lm.bucket(w, s.buckets)] += c
        once[maxent_lm.bucket(w, s.buckets)] += c == 1
    vocabulary = maxent_lm.Vocabulary(words, counts, int(counts.sum()), 40, sums, once)
    model = maxent_lm.Model(s, vocabulary)
    r = np.random.default_rng(2)
    model.learn(r.integers(0, s.contexts - 1, 600), np.array([0, 100, 300]))
    index, context, _, rare = vocabulary.prepared(s)
    total = 0.0
    for w in words:
        ids = np.array([3, 5, context[index[w]]], np.int64)
        total += 10 ** (model.log10(ids, np.array([0]))[2] + rare[index[w]])
    for b in range(s.buckets):
        ids = np.array([3, 5, s.frequent + b], np.int64)
        total += 10 ** model.log10(ids, np.array([0]))[2] * (once[b] + 1) / (sums[b] + once[b] + 1)
    assert total == pytest.approx(1, abs=1e-4)


def test_every_training_document_moves_the_weights(spark):
    s = maxent_lm.Settings()
    words = [f"w{i}".encode() for i in range(s.frequent)]
    vocabulary = maxent_lm.Vocabulary(words, np.ones(s.frequent, np.int64), s.frequent, s.frequent, np.zeros(s.buckets), np.zeros(s.buckets))
    rows = [(i, True, 2, np.array([i, 1000], np.uint32).tobytes()) for i in range(60)] + [(60, False, 2, np.array([60, 1000], np.uint32).tobytes())]
    model = maxent_lm.train(spark.createDataFrame(rows, "uid long, train boolean, n_tokens long, ids binary"), maxent_lm.Model(s, vocabulary), s)
    moved = (model.one[:61] != 0).any(1)
    assert moved[:60].all() and not moved[60]
    with pytest.raises(ValueError):
        maxent_lm.Settings(rounds=4, share=16)


def test_scores_do_not_hang_on_the_layout(corpus):
    _, df = corpus
    rule = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 1
    one, two = ({(r.doc_id, r.n_tokens): r for r in maxent_lm.score_documents(df.repartition(n), rule, SMALL).collect()} for n in (2, 7))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert (r.score, r.base_score) == pytest.approx((two[k].score, two[k].base_score), rel=1e-6)


def test_learning_holds_features_of_a_batch_only():
    s = maxent_lm.Settings(classes=4, members=8, buckets=4, hashed=256, batch=4096)
    vocabulary = maxent_lm.Vocabulary([f"w{i}".encode() for i in range(32)], np.arange(40, 8, -1), 10**6, 100, np.ones(4), np.ones(4))
    r = np.random.default_rng(6)
    ids, starts = r.integers(0, 36, 500_000).astype(np.uint32), np.arange(0, 500_000, 250)
    model = maxent_lm.Model(s, vocabulary)
    tracemalloc.start()
    model.learn(ids, starts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12e6  # all features at once are six arrays of 4 MB
    whole = maxent_lm.Model(replace(s, batch=1 << 20), vocabulary)
    whole.one, whole.two = model.one, model.two
    np.testing.assert_allclose(model.log10(ids, starts), whole.log10(ids, starts), rtol=1e-5)


def test_gradients_are_summed_by_row():
    r = np.random.default_rng(7)
    rows = np.sort(np.minimum(r.zipf(1.5, 3000), 200))
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    error, at = r.normal(size=(1000, 5)), r.integers(0, 1000, 3000)
    np.testing.assert_allclose(maxent_lm.Model._sums(error, at, first), np.add.reduceat(error[at], first, axis=0), atol=1e-9)


def test_hashed_rows_grow_with_the_vocabulary():
    s = maxent_lm.Settings()
    assert [s.grown(n).hashed for n in (0, 1 << 21, (1 << 21) + 1, 10**7, 10**12)] == [1 << 14, 1 << 14, 1 << 15, 1 << 17, 1 << 18]


# toxicity


def test_neighbours_are_exact():
    r = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        ids = np.sort(r.choice(50, r.integers(0, 8), replace=False))
        w = r.integers(1, 4, len(ids)).astype(float)
        vectors.append((ids, w / np.sqrt((w**2).sum()) if len(ids) else w))
    index = toxicity.BlockMaxIndex(vectors, 50, 16)
    dense = np.zeros((300, 50))
    for i, (a, w) in enumerate(vectors):
        dense[i, a] = w
    for ids, w in vectors[:60]:
        sim = dense[:, ids] @ w
        expected = [i for i in np.lexsort((np.arange(300), -np.round(sim, 12))) if sim[i] > 0][:7]
        near, got = index.nearest(ids, w, 7)
        assert near.tolist() == expected
        np.testing.assert_allclose(got, sim[near])


def test_frequent_terms_are_scored_for_a_batch_of_queries():
    r = np.random.default_rng(5)
    vectors = []
    for _ in range(400):
        ids = np.unique(np.minimum(r.zipf(1.3, r.integers(1, 60)) - 1, 499))
        w = r.integers(1, 9, len(ids)).astype(float)
        vectors.append((ids, w / np.sqrt((w**2).sum())))
    index, plain = toxicity.BlockMaxIndex(vectors, 500, 16, 8), toxicity.BlockMaxIndex(vectors, 500, 16, 0)
    assert len(index.dense) == 8 and not len(plain.dense) and len(index.row) + np.count_nonzero(index.dense) == len(plain.row)
    for v, part in zip(vectors, index.frequent_part(vectors), strict=True):
        for found in (index.nearest(*v, 9, part), index.nearest(*v, 9)):
            assert found[0].tolist() == plain.nearest(*v, 9)[0].tolist()
            np.testing.assert_allclose(found[1], plain.nearest(*v, 9)[1], atol=1e-12)


def test_toxicity(spark, nothing):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        words = [f"w{r.randrange(80)}" for _ in range(r.choice([5, 30, 200]))] + ["Vile!", "rotten"] * bad
        r.shuffle(words)
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, ""), (901, "", ""), (902, "vile " * 50_000, ""), (None, "rotten", ""), (903, "w1", ""), (903, "w1", "")]
    labels += [(3, 1, None), (None, 1, 1), (7, 1, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = marks.where("doc_id < 400")
    model = toxicity.learn(docs, train)
    found = {x.doc_id: x for x in toxicity.score_documents(docs, model).collect()}
    truth = [(found[i].score >= 0.5) == (t == 1) for i, _, t in labels[400:500]]
    assert np.mean(truth) > 0.98
    assert found[902].score > 0.5 and found[900].score == found[901].score < 0.5 and len(found[902].evidence) == 3
    assert toxicity.score_documents(docs, model).count() == len(rows) and toxicity.score_documents(nothing, model).count() == 0
    assert toxicity.learn(docs, marks.limit(0)) == 0.0
    alone = toxicity.learn(docs, marks.where("toxic = 1"))
    assert 0.9 < alone < 1 and toxicity.score_documents(docs, alone).first().score == alone


def test_neighbours_from_raw_texts(spark):
    r = random.Random(8)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 900}" for _ in range(4000)]
    texts = [" ".join([r.choice(vocabulary) for _ in range(r.choice([3, 20, 90]))] + ["awful"] * (i % 4 == 0)) for i in range(160)]
    texts[50], texts[51], texts[120] = texts[49], texts[49], texts[8]  # ties
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int"))
    sample = model.ids.tolist()
    label = {i: i % 4 == 0 for i in sample}
    words = [Counter(t.split()) for t in texts]
    kinds = sorted(set().union(*(words[i] for i in sample)))
    has = {w: sum(w in words[i] for i in sample) for w in kinds}
    bad = {w: sum(w in words[i] and label[i] for i in sample) for w in kinds}
    n, share = len(sample), sum(label.values()) / len(sample)
    weight = {w: math.log((n + 1) / (has[w] + 1)) * (0.1 + abs(bad[w] - has[w] * share) / math.sqrt(has[w] * share * (1 - share) * (1 - has[w] / (n + 1)) + 1)) for w in kinds}

    def vector(i):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in words[i].items() if w in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(i) for i in range(160)}
    found = {x.doc_id: x.evidence for x in toxicity.score_documents(docs, model).collect()}
    for i in range(160):
        sim = {j: sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()) for j in sample}
        best = sorted((j for j in sample if sim[j] > 0), key=lambda j: (-round(sim[j], 12), sample.index(j)))[:3]
        assert [e.id for e in found[i]] == best
        np.testing.assert_allclose([e.similarity for e in found[i]], [sim[j] for j in best])
    assert all(found[i] for i in range(160))


# pages


@pytest.fixture(scope="module")
def trees():
    return html_extract.learned()


def test_extraction_of_generated_pages(trees):
    teacher = html_extract.Teacher(1234)
    good = total = 0
    for _ in range(150):
        page, share, _ = teacher.lesson()
        kept = html_extract.decode(page, trees.score(page.x))
        for k, s, n in zip(kept, share, page.own, strict=True):
            if n:
                good, total = good + (k == (s > 0.5)), total + 1
    assert good / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>Tom &amp; Jerry</h1><p>First   para&shy;graph with <b>bold<br>and a break, long enough to be text, it says so here.
<p>Second &lt;tag&gt; paragraph &#233;t&eacute;, which also goes on for a while, and then ends.<script>var t="</p>";</script></p><ul><li>item one of the list</li><li>item two of the list</li></ul></article>
<div class="comments"><h3>Comments</h3><p>reader says hello to all of you, again and again.</p></div><div class="ad">Buy now</div><footer>&copy; site</footer></body>"""


def test_extraction_of_a_page(trees):
    text = html_extract.extract([PAGE], trees)[0]
    assert text.split("\n") == ["Tom & Jerry", "First para\xadgraph with bold and a break, long enough to be text, it says so here.", "Second <tag> paragraph été, which also goes on for a while, and then ends.", "item one of the list", "item two of the list"]


LINE = "The council met on Tuesday evening to discuss the new bridge across the river, and after two hours of debate it agreed on the plan."
OTHERS = [
    (
        """<html><head><title>x</title><style>a{}</style></head><body class="home"><div id="top-bar"><a href="/">Daily News</a> <a href="/login">Log in</a></div>
<ul class="main-menu"><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li></ul>
<div class="wrapper"><div class="content"><h1>Council agrees on bridge</h1><p>%LINE%</p><p>Work is to begin in spring, said the mayor, who had asked for the money for years.</p><blockquote>We have waited long for this day, and it has come.</blockquote><p>%LINE% It will cost four million.</p></div>
<div class="sidebar widget-area"><h3>Most read</h3><ul><li><a href="/1">Storm hits the coast</a></li><li><a href="/2">Ten recipes for autumn</a></li></ul></div></div>
<form class="newsletter"><label>Get our newsletter</label><input type="text"><button>Subscribe</button></form><div id="footer"><p>Copyright 2024 Daily News. All rights reserved.</p></div></body></html>""",
        ["Council agrees on bridge", LINE, "Work is to begin in spring, said the mayor, who had asked for the money for years.", "We have waited long for this day, and it has come.", LINE + " It will cost four million."],
    ),
    (
        """<body><nav class="breadcrumb"><a href="/">Home</a> &gt; <a href="/docs">Docs</a></nav><main><h1>Install</h1><p>To install the program, unpack the archive and run the script that lies in its top folder.</p><pre>make install</pre><table><tr><td>Option</td><td>Meaning</td></tr><tr><td>prefix</td><td>where the files go</td></tr></table><ol><li>Unpack the archive into a folder of its own.</li><li>Run the script as the user who will use it.</li></ol><p>%LINE%</p></main><aside class="related"><a href="/a">Upgrade</a><a href="/b">Remove</a></aside><div class="cookie-banner">This site uses cookies. <a href="#">Accept</a></div><section id="comments"><h2>3 comments</h2><div class="comment"><p>Worked for me at once, thank you very much for writing this down.</p></div></section></body>""",
        ["Install", "To install the program, unpack the archive and run the script that lies in its top folder.", "make install", "Option", "Meaning", "prefix", "where the files go", "Unpack the archive into a folder of its own.", "Run the script as the user who will use it.", LINE],
    ),
    (
        """<div class="post"><div class="entry-title">A walk in the hills</div><div class="meta">by Ann, 3 May</div><div class="entry-content">%LINE%<br><br>%LINE% We went on until dusk.</div><div class="share"><a href="#">Share</a><a href="#">Tweet</a></div></div><div class="ad-slot">Buy two shoes and get one free today</div>""",
        ["A walk in the hills", "by Ann, 3 May", LINE + " " + LINE + " We went on until dusk."],
    ),
]


@pytest.mark.parametrize("number", range(3))
def test_extraction_of_pages_unlike_the_generated(trees, number):
    page, lines = OTHERS[number]
    assert html_extract.extract([page.replace("%LINE%", LINE)], trees)[0].split("\n") == lines


def test_decoding_keeps_no_child_of_a_dropped_element(trees):
    for seed in range(20):
        page = html_extract.Teacher(seed).lesson()[0]
        r = np.random.default_rng(seed)
        kept = html_extract.decode(page, r.normal(0, 3, len(page.nodes)))
        assert len(kept) == len(page.nodes)


def test_broken_pages(spark, trees):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<div><p>cut off in the mid"), (4, "u", "plain text without any tag at all, but with words."), (5, "u", "<" * 3000), (6, "u", "<a href=\"" * 500), (7, None, "<div>" * 3000 + "deep"), (8, "u", "<p>" + "long words here, " * 60_000 + "</p>"), (8, "u", "</p></div>"), (None, "u", "<!-- only -->"), (9, "u", "<script>never closed <p>text")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {(r.page_id, r.n_chars): r.text for r in html_extract.extract_pages(df, trees).collect()}
    assert len(found) == len(rows) and all(n == len(t) for (_, n), t in found.items())
    assert found[(1, 0)] == found[(2, 0)] == found[(9, 0)] == "" and any("long words here" in t for t in found.values())
    assert html_extract.extract_pages(df.limit(0), trees).count() == 0


def test_long_attribute_values_are_read_whole():
    for quote in "\"'":
        root = html_extract.parse(f"<div data-state={quote}{'a' * 2500} x > y secret{quote}>Body</div>")
        assert [x for x in root.items if isinstance(x, str)] == [] and root.children[0].items == ["Body"]
    assert [c.items for c in html_extract.parse('<p class="x>one</p><p>two</p>').children] == [["one"], ["two"]]


def test_deep_elements_are_opened():
    node = html_extract.parse("<div>" * 400 + "<script>var x</script><p>one</p><p>two</p>" + "</div>" * 400 + "<p>end</p>")
    assert [c.tag for c in node.children] == ["div", "p"]
    for _ in range(400):
        node = node.children[0]
    assert [c.tag for c in node.children] == ["script", "p", "p"] and node.children[0].hidden and [c.items for c in node.children] == [[], ["one"], ["two"]]


def test_scratch_tables_go(spark):
    with scratch():
        kept = written(spark.range(5), "kept")
        assert kept.count() == 5
    with pytest.raises(Exception):
        kept.count()
