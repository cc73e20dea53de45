import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strictpast.llm import common, mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's 'tis don't!! I'LL <|endoftext|>x a<|startoftext|>", "x y z ｚｆ 1234.5% café CAFÉ café", "İstanbul ΣΑΣ ſ ǅ \x1c b\x85c …— 'S'll", "", "\n\t ", "日本語。 한국 ½ ²", "a.'s ... ''' 're", "<|ENDOFTEXT|> <|StartOfText|>x <|endoftext|><|EndOfText|> a<|ENDOFTEXT|>b. <|STARTOFTEXT|>!"]


@pytest.fixture(scope="module")
def words():
    return packing.WordTokens(PATH, 50)


def test_words_equal_the_tokenizer(words, corpus):
    r = random.Random(1)
    texts = ODD + [x[1] or "" for x in corpus[0]] + ["".join(r.choice("aZéÉ'.,!s 1́ #\n<|>ll") for _ in range(30)) for _ in range(400)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_round_trip(corpus):
    rows, df = corpus
    found = packing.pack(df, PATH, capacity=64, with_ids=True).toPandas()
    t = Tokenizer.from_file(PATH)
    expected = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x, *_ in rows)
    for (i, ids), n in expected.items():
        part = found[found["doc_id"] == i].sort_values("piece")
        assert len(part) == n * -(-len(ids) // 64)
        for p in part.itertuples():
            raw = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.ids == raw and p.ids_crc32 == zlib.crc32(raw) and p.start == 64 * p.piece
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 64
    whole = packing.sequences(packing.pack(df, PATH, capacity=64, with_ids=True)).toPandas()
    assert whole["ids"].map(len).sum() == 4 * found["length"].sum()


def best_fit(lengths, capacity):
    """Sequences that plain best-fit decreasing opens, document by document."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in room if x >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_places_every_count_once(lengths):
    counts = Counter(lengths)
    slots = packing.plan(dict(counts), 40)
    rooms = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, sequences, per, first, offset in slots:
        assert sequences > 0 and per > 0
        ranks[length].append((rank, sequences * per))
        for s in range(first, first + sequences):
            rooms[s].append((offset, per * length))
    for length, n in counts.items():
        at = 0
        for rank, size in sorted(ranks[length]):
            assert rank == at
            at += size
        assert at == n
    for parts in rooms.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 40
    assert sorted(rooms) == list(range(len(rooms)))
    assert len(rooms) <= best_fit(lengths, 40) + 2


def test_ranks_over_salts_and_empty_table(corpus, nothing, monkeypatch):
    monkeypatch.setattr(packing, "SALT", 0.3)
    found = packing.pack(corpus[1], PATH, capacity=32).toPandas()
    assert not found.duplicated(["sequence_id", "offset"]).any()
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert packing.pack(nothing, PATH).count() == 0


@pytest.fixture(scope="module")
def domains(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        kind = ["high", "low", "toxic"][(i % 10 > 6) + (i % 10 > 8)]
        words = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randint(5, 60))]
        if kind == "low":
            words = [w + "###" for w in words]
        if kind == "toxic":
            words += ["vilest"] * 3
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, kind))
    rows += [(900, None, None), (901, "", None), (None, "alpha beta", None), (902, "alpha", None), (902, "alpha", None)]
    df = spark.createDataFrame([(a, b, "clash", 1.0) for a, b, _ in rows], "doc_id long, text string, domain string, tokens double")
    return rows, df, spark.createDataFrame(labels, "doc_id long, domain string")


def brute_rates(p, t, goal, floor, steps=4000):
    """Projected gradient on all rows in numpy."""
    x = np.full(len(t), max(1.0, floor))
    a = p * t[:, None]
    scale = np.linalg.inv(p.T @ a)
    for _ in range(steps):
        x = np.maximum(floor, x + 0.05 * p @ (scale @ (goal - a.T @ x)))
    return x


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_rates_reach_targets(domains, floor):
    rows, df, labels = domains
    targets = {"high": 0.7, "low": 0.2, "toxic": 0.1}
    rates, report = mixing.mixing_rates(df, labels, mixing.Settings(targets=targets), floor)
    out = rates.toPandas()
    assert len(out) == len(rows) and (out["rate"] >= floor).all()
    kinds = {i: k for i, _, k in rows if k}
    best = {r.doc_id: max(r.posteriors, key=r.posteriors.get) for r in out.dropna(subset=["doc_id"]).itertuples()}
    assert np.mean([best[i] == k for i, k in kinds.items()]) > 0.97
    goal, got = np.array(report["goal"]), np.array(report["got"])
    names = sorted(targets)
    p = np.array([[x[n] for n in names] for x in out["posteriors"]])
    t = out["tokens"].to_numpy(float)
    np.testing.assert_allclose((p * (t * out["rate"].to_numpy())[:, None]).sum(0), got, rtol=1e-6)
    x = brute_rates(p, t, goal, floor)
    brute = np.abs((p * (t * x)[:, None]).sum(0) - goal).sum()
    assert np.abs(got - goal).sum() <= brute + 0.01 * goal.sum()
    whole = np.floor(out["rate"])
    assert ((out["copies"] == whole) | (out["copies"] == whole + 1)).all()


def test_mixed_documents(domains, spark):
    rows, df, labels = domains
    out = mixing.mixed(df, labels, mixing.Settings(targets={"high": 0.8, "low": 0.1, "toxic": 0.1}))
    assert out.columns == df.columns
    counts = Counter(r.doc_id for r in out.collect())
    assert all(counts[i] >= 1 for i, *_ in rows)


def test_mixing_edges(domains, spark):
    _, df, labels = domains
    assert mixing.mixing_rates(df.limit(0), labels)[0].count() == 0
    none = mixing.mixing_rates(df, labels.limit(0))[0]
    assert none.agg(F.min("rate"), F.max("rate")).first() == (1.0, 1.0)
    one = mixing.mixing_rates(df, labels.where("domain = 'high'"), mixing.Settings(targets={"high": 1.0}))[0]
    assert one.count() == df.count()
    plan = none._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_runs_no_python(domains):
    _, df, labels = domains
    rates, _ = mixing.mixing_rates(df, labels)
    plan = rates._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixing_reads_very_long_texts(domains, spark):
    _, df, labels = domains
    long = spark.createDataFrame([(5000, "alpha beta " * 200_000, "clash", 1.0), (5001, "x" * 2_000_000, "clash", 1.0)], df.schema)
    rates = {r.doc_id: r for r in mixing.mixing_rates(df.unionByName(long), labels)[0].collect()}
    assert rates[5000].tokens == 400_000 and rates[5001].tokens == 1 and abs(sum(rates[5000].posteriors.values()) - 1) < 1e-9


def test_workers_forget_what_other_stages_kept():
    common.once_a_process("one", lambda: 1)
    common.once_a_process("two", lambda: 2)
    run = common.frugal(lambda batches: (x for x in batches), "two")
    assert list(run([5, 6])) == [5, 6]
    assert common.once_a_process("one", lambda: 3) == 3 and common.once_a_process("two", lambda: 3) == 2
