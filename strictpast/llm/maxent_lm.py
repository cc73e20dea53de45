"""Language-model scoring with a hashed maximum-entropy model.

Tokens are ASCII-lower-cased words split at ASCII white space, then one end token. The ``classes * members`` most
frequent training tokens are dealt to classes by frequency; every other token belongs to one of ``buckets`` classes by
its ending. A token's probability is that of its class times that within its class. Both factors are log-linear in
hashed features of the context: the previous token, the one before it (skip), and the two together (n-gram), over a
unigram prior. N-grams, and the features within a class, know every word by a hash of its own, whether frequent or not,
and the rows they are hashed to grow with the vocabulary. Inside a bucket words share by their training counts, and
unseen words together have as much as words seen once.

Word counts, class priors and bucket sums are taken over all training documents, by shuffles that grow with the
input. Weights are learned in rounds: learners take gradient steps on their share of the round's documents, and the
mean of their weights, weighted by tokens, starts the next round. Every round takes a fresh quarter of the training
documents, so the rounds learn from all of them. Round, learner and order within it hang on a document's tokens alone,
so scores don't depend on how the input is laid out. Scoring runs over all documents in sparse numpy batches. Words
outside the ``listed`` most frequent are looked up by a join, so nothing that grows with the vocabulary is broadcast.

A null or empty text has just the end token. Repeated rows are scored each. A null id is held out or not as the empty
text's CRC says. Without training documents both scores are 0 (one token type, certain). An empty table gives an empty result.
Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import Held, crc32_of_id, frugal, written


#: The low bits of a token's code tell its word (frequent) or bucket, the high bits hash a word that is not frequent.
LOW = 12
VOID = (1 << LOW) - 1


@dataclass(frozen=True)
class Settings:
    """A round learns from one of ``share`` parts of the training documents; all parts have their round.

    ``hashed`` is the number of hashed rows at least; there is one for every ``words_per_row`` distinct words, up to
    ``most_hashed``, the bound of what a learner holds.
    """

    classes: int = 32
    members: int = 48
    buckets: int = 16
    listed: int = 1 << 17
    hashed: int = 1 << 14
    most_hashed: int = 1 << 18
    words_per_row: int = 128
    rounds: int = 4
    share: int = 4
    learner_tokens: int = 4_000_000
    most_learners: int = 400
    batch: int = 16_384
    rate: float = 0.25

    def __post_init__(self):
        if self.rounds < self.share:
            raise ValueError("fewer rounds than shares leave training documents out")
        if self.contexts > VOID:
            raise ValueError("too many classes, members or buckets for a token's code")

    def grown(self, kinds: int) -> Settings:
        """These settings with hashed rows for ``kinds`` distinct words."""
        rows = 1 << max(0, -(-kinds // self.words_per_row) - 1).bit_length()
        return replace(self, hashed=max(self.hashed, min(self.most_hashed, rows)))

    @property
    def frequent(self) -> int:
        return self.classes * self.members

    @property
    def outputs(self) -> int:
        return self.classes + self.buckets

    @property
    def contexts(self) -> int:
        return self.frequent + self.buckets + 1


END = b""


def bucket(word: bytes, buckets: int) -> int:
    """A word's bucket: a hash of its last three bytes."""
    return zlib.crc32(word[-3:]) % buckets


def code(word: bytes, s: Settings) -> int:
    """The code of a word that is not frequent."""
    return zlib.crc32(word) >> LOW << LOW | s.frequent + bucket(word, s.buckets)


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word: binary, bucket, c) over the rows of ``docs`` (text: binary or null)."""
    many = settings.buckets

    def run(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([bucket(w, many) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], ["word", "bucket", "c"])
            held.clear()
            return got

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update((text or b"").lower().split())
                held[END] += 1
                if len(held) > 200_000:
                    yield out()
        if held:
            yield out()

    parts = docs.select("text").mapInArrow(frugal(run), "word binary, bucket int, c long")
    return parts.groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What is broadcast of the counts: ``listed`` words at most, and sums."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    kinds: int
    sums: np.ndarray  # per bucket, the counts of words outside the frequent ones
    once: np.ndarray  # per bucket, those that occur once

    def prepared(self, s: Settings):
        k = min(s.frequent, len(self.words))
        context = np.empty(len(self.words) + 1, np.uint32)
        context[:k] = np.arange(k)
        context[k:-1] = [code(w, s) for w in self.words[k:]]
        low = (context[k:-1] & VOID).astype(np.int64) - s.frequent
        base = np.append(np.log10(self.counts + 0.5), 0.0)
        rare = np.zeros(len(self.words) + 1)
        rare[k:-1] = np.log10(self.counts[k:]) - np.log10(self.sums + self.once + 1)[low]
        return {w: i for i, w in enumerate(self.words)}, context, base, rare


def learn_vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The list ends where words of equal count would no longer all fit, so no task ranks words; only where the frequent
    # ones alone need it are words of one count ranked, and then a few of each task.
    least, held = 0, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(s.listed + 1).collect():  # a row per count
        if held + r["n"] > s.listed:
            break
        least, held = r["c"], held + r["n"]
    top = counts.where(F.col("c") >= least) if held else counts.limit(0)
    if held < min(s.frequent, kinds):
        rest = counts.where(F.col("c") < least) if held else counts
        top = top.unionByName(rest.orderBy(F.desc("c"), "word").limit(s.frequent - held))
    top = top.select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])  # at most ``listed`` words
    words, c = [bytes(x) for x in top.column(0).to_pylist()], top.column(1).to_numpy().astype(np.int64)
    sums, once = np.zeros(s.buckets), np.zeros(s.buckets)
    if words:
        at = min(s.frequent, len(words)) - 1
        below = (F.col("c") < int(c[at])) | (F.col("c") == int(c[at])) & (F.col("word") > F.lit(bytearray(words[at])))
        for r in counts.where(below).groupBy("bucket").agg(F.sum("c"), F.count_if(F.col("c") == 1)).collect():
            sums[r[0]], once[r[0]] = r[1], r[2]
    return Vocabulary(words, c, int(total), int(kinds), sums, once)


def encode(docs: DataFrame, vocabulary: Held, s: Settings) -> DataFrame:
    """(uid, id, train, n_tokens, n_listed, ids: uint32 codes, base, rare, words, times, low): one row per document.

    ``words`` are those outside the list with how often they occur and their buckets.
    """
    frequent = s.frequent

    def run(batches):
        index, context, base, rare = vocabulary.value.prepared(s)
        uid = TaskContext.get().partitionId() << 40
        end = index.get(END, -1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                cols = [[] for _ in range(9)]
                for text in part.column(2).to_pylist():
                    tokens = (text or b"").lower().split()
                    at = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
                    at = np.append(at, end)
                    ids = context[at]
                    far = np.flatnonzero(at < 0)
                    other: Counter = Counter()
                    if len(far):
                        names = [tokens[i] if i < len(tokens) else END for i in far.tolist()]
                        other.update(names)
                        codes = {w: code(w, s) for w in other}
                        ids[far] = [codes[w] for w in names]
                    near = at[at >= 0]
                    row = (uid, len(at), len(near), ids.tobytes(), float(base[near].sum()), float(rare[near].sum()), list(other), list(other.values()), [(codes[w] & VOID) - frequent for w in other])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    uid += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([made[0], part.column(0), part.column(1), *made[1:]], ["uid", "id", "train", "n_tokens", "n_listed", "ids", "base", "rare", "words", "times", "low"])

    return docs.select("id", "train", "text").mapInArrow(frugal(run), "uid long, id long, train boolean, n_tokens long, n_listed long, ids binary, base double, rare double, words array<binary>, times array<long>, low array<int>")


class Model:
    """Weights of both factors. Rows of ``one`` are context features, of ``two`` features of a class and a context."""

    def __init__(self, s: Settings, vocabulary: Vocabulary):
        self.s = s
        k = min(s.frequent, len(vocabulary.words))
        counts = np.zeros(s.frequent)
        counts[:k] = vocabulary.counts[:k]
        mass = np.concatenate([counts.reshape(s.classes, s.members).sum(1), vocabulary.sums + vocabulary.once])
        self.prior = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
        inner = counts.reshape(s.classes, s.members)
        # Members that no word holds keep a probability of next to nothing.
        self.inner = np.log(np.maximum(inner, 1e-6) / np.maximum(inner, 1e-6).sum(1, keepdims=True)).astype(np.float32)
        self.one = np.zeros((2 * s.contexts + s.hashed, s.outputs), np.float32)
        self.two = np.zeros((s.hashed, s.members), np.float32)
        self.speed = [np.full(len(self.one), 1e-2, np.float32), np.full(len(self.two), 1e-2, np.float32)]

    def features(self, ids: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Rows of ``one`` per token, and the two context codes; ``starts`` are the first tokens of documents."""
        s = self.s
        prev = np.full(len(ids), VOID, np.int64)
        prev[1:], prev[starts] = ids[:-1], VOID
        back = np.full(len(ids), VOID, np.int64)
        back[1:] = prev[:-1]
        back[starts] = VOID
        both = ((prev * 2654435761 + back * 40503 + 12345) >> 9) % s.hashed
        return [np.minimum(prev & VOID, s.contexts - 1), s.contexts + np.minimum(back & VOID, s.contexts - 1), 2 * s.contexts + both], prev, back

    def steps(self, ids: np.ndarray, starts: np.ndarray):
        """(slice, ids, features) of ``batch`` tokens at a time, so features of a batch of documents are never all in memory."""
        for a in range(0, len(ids), self.s.batch):
            lo, hi = max(0, a - 2), min(len(ids), a + self.s.batch)  # two tokens before are context
            own = ids[lo:hi].astype(np.int64)
            first, last = np.searchsorted(starts, (lo, hi))
            rows, prev, back = self.features(own, starts[first:last] - lo)
            cut = slice(a - lo, None)
            yield slice(a, hi), own[cut], [r[cut] for r in rows], prev[cut], back[cut]

    def inner_rows(self, own: np.ndarray, prev: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        return [((own * 7919 + x * 104729 + salt) * 2654435761 >> 9) % self.s.hashed for x, salt in ((prev, 1), (back, 2))]

    @staticmethod
    def _soft(score: np.ndarray) -> np.ndarray:
        np.clip(score, -60, 60, out=score)
        np.exp(score, out=score)
        score /= score.sum(1, keepdims=True)
        return score

    def forward(self, ids: np.ndarray, rows: list[np.ndarray], prev: np.ndarray, back: np.ndarray):
        """Both factors' distributions: (outputs per token), and for frequent tokens (members), with what they used."""
        s = self.s
        ids = ids & VOID
        own = np.where(ids < s.frequent, ids // s.members, s.classes + ids - s.frequent)
        score = self.one.take(rows[0], 0)
        for r in rows[1:]:
            score += self.one.take(r, 0)
        score += self.prior
        p = self._soft(score)
        at = np.flatnonzero(ids < s.frequent)
        cls = own[at]
        inner = self.inner_rows(cls, prev[at], back[at])
        q = self.inner.take(cls, 0)
        for r in inner:
            q += self.two.take(r, 0)
        return own, p, at, inner, self._soft(q), ids[at] % s.members

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log10 probability of each token's class and, in a frequent class, of the token within it."""
        out = np.empty(len(ids))
        for cut, *part in self.steps(ids, starts):
            own, p, at, _, q, member = self.forward(*part)
            got = np.log10(p[np.arange(len(own)), own].astype(np.float64) + 1e-30)
            got[at] += np.log10(q[np.arange(len(at)), member].astype(np.float64) + 1e-30)
            out[cut] = got
        return out

    @staticmethod
    def _sums(error: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What ``np.add.reduceat(error[at], first)`` is, which is slow by rows: long runs at once, of short ones a member at a time."""
        size = np.diff(np.r_[first, len(at)])
        out = error.take(at[first], 0)
        for i in np.flatnonzero(size > 16).tolist():
            out[i] = error.take(at[first[i] : first[i] + size[i]], 0).sum(0)
        short, k = np.flatnonzero((size > 1) & (size <= 16)), 1
        while len(short):
            out[short] += error.take(at[first[short] + k], 0)
            k += 1
            short = short[size[short] > k]
        return out

    def _step(self, which: int, rows: list[np.ndarray], error: np.ndarray) -> None:
        """One gradient step, with the rate of each row shrinking by its own past gradients."""
        table, speed = (self.one, self.two)[which], self.speed[which]
        r = np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        sorted_rows = r[order]
        first = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
        g = self._sums(error, order % len(error), first)
        at = sorted_rows[first]
        speed[at] += (g * g).mean(1)
        table[at] -= self.s.rate * g / np.sqrt(speed[at])[:, None]

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        for _, part, rows, prev, back in self.steps(ids, starts):
            own, p, at, inner, q, member = self.forward(part, rows, prev, back)
            p[np.arange(len(own)), own] -= 1
            self._step(0, rows, p)
            if len(at):
                q[np.arange(len(at)), member] -= 1
                self._step(1, inner, q)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of documents, and where each begins."""
    parts = column.to_pylist()
    lengths = np.array([len(x) // 4 for x in parts], np.int64)
    ids = np.frombuffer(b"".join(parts), np.uint32)
    return ids, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def train(encoded: DataFrame, model: Model, s: Settings) -> Model:
    """Rounds of learners that step apart and are averaged by tokens."""
    spark = encoded.sparkSession
    rows = encoded.where("train").select("ids", "n_tokens", F.xxhash64("ids").alias("mark")).withColumn("turn", F.pmod("mark", F.lit(s.share)))
    tokens = {r[0]: r[1] for r in rows.groupBy("turn").agg(F.sum("n_tokens")).collect()}  # a row per share
    for turn in range(s.rounds):
        many = tokens.get(turn % s.share, 0)
        if not many:
            continue
        learners = max(1, min(s.most_learners, -(-int(many) // s.learner_tokens)))
        held = Held(spark, model)
        block = 256

        def run(batches, held=held):
            own, seen, name = None, 0, None

            def out():
                for part, table in enumerate((own.one, own.two, own.speed[0][:, None], own.speed[1][:, None])):
                    for a in range(0, len(table), block):
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([a], pa.int32()), pa.array([name], pa.int32()), pa.array([seen], pa.int64()), pa.array([table[a : a + block].tobytes()], pa.binary())], ["part", "at", "learner", "seen", "body"])

            for batch in batches:
                learner = batch.column(0).to_numpy()
                for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(np.diff(learner)) + 1, len(learner)]), strict=True):
                    if lo == hi:
                        continue
                    if name != learner[lo]:  # a task may serve more than one learner
                        if own is not None:
                            yield from out()
                        own, seen, name = _copy(held.value), 0, learner[lo]
                    ids, starts = _joined(batch.column(1).slice(lo, hi - lo))
                    own.learn(ids, starts)
                    seen += len(ids)
            if own is not None:
                yield from out()

        def mean(table: pa.Table) -> pa.Table:
            table = table.sort_by("learner")
            weights = table.column("seen").to_numpy().astype(np.float64)
            total = sum(np.frombuffer(x, np.float32) * w for x, w in zip(table.column("body").to_pylist(), weights / weights.sum(), strict=True))
            return pa.table([table.column("part").slice(0, 1).cast(pa.int32()), table.column("at").slice(0, 1).cast(pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "at", "body"])

        mine = rows.where(F.col("turn") == turn % s.share).select(F.pmod(F.shiftrightunsigned("mark", 20), F.lit(learners)).cast("int").alias("learner"), "ids", "mark")
        dealt = mine.repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "mark").select("learner", "ids")
        found = dealt.mapInArrow(frugal(run), "part int, at int, learner int, seen long, body binary")
        merged = found.groupBy("part", "at").applyInArrow(mean, "part int, at int, body binary").toArrow()  # the size of one model
        model = _copy(model)
        tables = (model.one, model.two, model.speed[0][:, None], model.speed[1][:, None])
        for name, at, body in zip(*(merged.column(i).to_pylist() for i in range(3)), strict=True):
            values = np.frombuffer(body, np.float32)
            tables[name][at : at + block] = values.reshape(-1, tables[name].shape[1])
    return model


def _copy(model: Model) -> Model:
    out = object.__new__(Model)
    out.__dict__.update(model.__dict__)
    out.one, out.two, out.speed = model.one.copy(), model.two.copy(), [x.copy() for x in model.speed]
    return out


def score_documents(docs: DataFrame, train_rule, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, train, n_tokens, n_known, train_tokens, base_score, score. ``train_rule``: a condition on the column ``id``."""
    s = settings
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("train", train_rule)
    counts = written(word_counts(rows.where("train"), s), "counts")
    vocabulary = learn_vocabulary(counts, s)
    s = s.grown(vocabulary.kinds)
    held = Held(spark, vocabulary)
    encoded = written(encode(rows, held, s), "encoded")
    scale = float(np.log10(vocabulary.total + 0.5 * (vocabulary.kinds + 1)))
    model = Held(spark, train(encoded, Model(s, vocabulary), s))

    def run(batches):
        own = model.value
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 128):
                ids, starts = _joined(batch.column(1).slice(lo, 128))
                out.append(np.add.reduceat(own.log10(ids, starts), starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], ["uid", "model"])

    far = encoded.select("uid", F.explode(F.arrays_zip("words", "times", "low")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("n"), F.col("x.low").alias("low"))
    listed_end = len(vocabulary.words)
    least = int(vocabulary.counts[-1]) if listed_end else vocabulary.total
    # Listed words can't be asked for; dropping all but the list's last count from the counts spares their shuffle.
    asked = far.join(counts.where(F.col("c") <= least).select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    whole = F.array(*[F.lit(float(x)) for x in np.log10(vocabulary.sums + vocabulary.once + 1)])
    unseen = F.array(*[F.lit(float(x)) for x in np.log10(vocabulary.once + 1)])
    n, low = F.col("n").cast("double"), F.col("low") + 1
    sums = asked.groupBy("uid").agg(
        F.sum(n * F.log10(F.col("c") + 0.5)).alias("far_base"),
        F.sum(n * (F.when(F.col("c") > 0, F.log10(F.greatest("c", F.lit(1)).cast("double"))).otherwise(F.element_at(unseen, low)) - F.element_at(whole, low))).alias("far_model"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"),
    )
    scored = encoded.select("uid", "ids").mapInArrow(frugal(run), "uid long, model double")
    final = encoded.select("uid", "id", "train", "n_tokens", "n_listed", "base", "rare").join(scored, "uid").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.col("model") + F.col("rare") + zero("far_model") if vocabulary.total else F.lit(0.0)
    base = F.col("base") + zero("far_base") - F.col("n_tokens") * scale if vocabulary.total else F.lit(0.0)
    return final.select(F.col("id").alias(id_col), "train", "n_tokens", (F.col("n_listed") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op5_lm_score(spark, sf_dir):
    from strictpast.llm.common import table

    found = score_documents(table(spark, sf_dir, "documents"), crc32_of_id("id") % 5 != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
