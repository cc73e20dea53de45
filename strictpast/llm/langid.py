"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes, labels every position with a distribution over the learned languages, and a document's
probabilities are the mean over all its positions. It is trained on the driver in numpy, by backpropagation through
time, on a sample bounded by ``Settings.docs_per_lang``; every document is then labelled over its whole text.

Long texts are read in chunks of ``chunk`` bytes with ``context`` bytes on either side, so states at a chunk's edge
have seen their surroundings. A score depends on the text alone: each lane of a batch is read from its own two ends, so
neither the rows beside it nor the layout of the input matter. A null text, or one without a letter, is ``und`` with score 0. Null languages are not
learned from; without any labelled row all is ``und``. Ties go to the language first in alphabetical order. Repeated rows
get equal answers, a null id is kept, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strictpast.llm.common import Held, bounded_sample, crc32_of_id, frugal


@dataclass(frozen=True)
class Settings:
    """``docs_per_lang`` bounds the training sample; the rest shape network, training and reading."""

    docs_per_lang: int = 600
    windows_per_doc: int = 4
    window: int = 64
    hidden: int = 16
    epochs: int = 5
    least_steps: int = 250
    batch: int = 192
    rate: float = 0.01
    chunk: int = 256
    context: int = 16
    lanes: int = 1536
    seed: int = 7


#: The symbol after the end of a lane, beside the 256 bytes. It leaves a state of zero as it is.
END = 256


def symbols(data: np.ndarray, lengths: np.ndarray | None) -> np.ndarray:
    """(steps, lanes) for bytes (lanes, steps), ``END`` from each lane's own length on."""
    across = np.ascontiguousarray(data.T).astype(np.intp)
    if lengths is not None:
        across[np.arange(len(across))[:, None] >= lengths] = END
    return across


class Network:
    """Two gated recurrent layers, one in each direction, and a softmax over their joint state at each position."""

    def __init__(self, classes: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden, self.classes = hidden, classes
        # axis 0: direction. Gates lie side by side: update, reset, candidate.
        self.p = {
            "E": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f),
            "U": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(f),
            "c": np.zeros((2, 1, hidden), f),
            "V": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, classes)).astype(f),
            "b": np.zeros(classes, f),
        }

    def logits(self, data: np.ndarray, lengths: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """(steps, lanes, classes) for bytes (lanes, steps). ``keep`` gathers what training needs.

        The backward layer reads ``END`` up to each lane's own length and so starts there from zero, and padding is never
        before a byte in either direction.
        """
        across = symbols(data, lengths)
        steps, lanes = across.shape
        h, kind = self.hidden, self.p["E"].dtype
        # Axis 0: gate, so that each lies in one piece. A sigmoid is 1 / (1 + exp(-x)), a tanh 1 - 2 / (1 + exp(2x)): weights
        # carry the factors, and what a gate scales is divided by 1 + exp(-x).
        factor = np.array([-1, -1, 2], kind)[:, None, None, None]
        E, U = (np.ascontiguousarray(self.p[k].reshape(2, -1, 3, h).transpose(2, 0, 1, 3) * factor) for k in "EU")
        end = np.zeros((3, 2, 1, h), kind)
        end[1] = np.inf  # nothing of the state gets into the candidate, which is zero
        E = np.concatenate([E, end], 2).reshape(3, 2 * (END + 1), h)
        c = np.repeat(self.p["c"] * 2, lanes, 1)
        both = np.concatenate([across, across[::-1] + END + 1], 1)
        state, one = np.zeros((2, lanes, h), kind), np.ones((), kind)
        out = np.empty((steps, 2, lanes, self.classes), kind)
        pre, own = np.empty((3, 2, lanes, h), kind), np.empty((3, 2, lanes, h), kind)
        flat, gates, (update, reset, fresh), inner = pre.reshape(3, 2 * lanes, h), pre[:2], pre, own[2]
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.take(E, both[t], axis=1, out=flat, mode="clip")
                np.matmul(state, U, out=own)
                gates += own[:2]
                np.exp(gates, out=gates)
                gates += one
                inner += c
                if keep is not None:
                    held = [state.copy(), one / update, one / reset, inner * 0.5]
                inner /= reset
                fresh += inner
                np.exp(fresh, out=fresh)
                fresh += one
                np.divide(-2 * one, fresh, out=fresh)
                fresh += one
                if keep is not None:
                    keep.append((*held, fresh.copy()))
                state -= fresh
                state /= update
                state += fresh
                np.matmul(state, self.p["V"], out=out[t])
        if keep is not None:
            keep.append(state)
        total = out[:, 0] + out[::-1, 1]
        total += np.tile(self.p["b"], (lanes, 1))
        return total

    @staticmethod
    def soft(logits: np.ndarray, axis: int = -1) -> np.ndarray:
        logits -= logits.max(axis, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis, keepdims=True)
        return logits

    def gradient(self, data: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """Loss and gradient of the mean cross-entropy over positions, by backpropagation through time."""
        lanes, steps = data.shape
        h = self.hidden
        keep: list = []
        lengths = (weights > 0).sum(1)
        across = symbols(data, lengths)
        prob = self.soft(self.logits(data, lengths, keep))
        last = keep.pop()
        rows = np.arange(lanes)
        loss = -float((np.log(prob[:, rows, labels] + 1e-9) * weights.T).sum() / weights.sum())
        prob[:, rows, labels] -= 1
        prob *= (weights.T / weights.sum())[:, :, None]
        behind = prob[::-1]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["E"] = np.zeros((2, END + 1, 3 * h), g["E"].dtype)
        g["b"] = prob.sum((0, 1))
        E, U, V = self.p["E"], self.p["U"], self.p["V"]
        down = np.zeros((2, lanes, h), np.float32)
        after = last
        for t in range(steps - 1, -1, -1):
            state, update, reset, inner, fresh = keep[t]
            top = np.stack([prob[t], behind[t]])
            g["V"] += after.transpose(0, 2, 1) @ top
            down = down + top @ V.transpose(0, 2, 1)
            d_fresh = down * (1 - update) * (1 - fresh * fresh)
            d_update = down * (state - fresh) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_inner = d_fresh * reset
            g["c"] += d_inner.sum(1, keepdims=True)
            d_own = np.concatenate([d_update, d_reset, d_inner], 2)
            d_pre = np.concatenate([d_update, d_reset, d_fresh], 2)
            g["U"] += state.transpose(0, 2, 1) @ d_own
            for k, now in ((0, across[t]), (1, across[steps - 1 - t])):
                order = np.argsort(now, kind="stable")
                sorted_bytes = now[order]
                first = np.flatnonzero(np.r_[True, sorted_bytes[1:] != sorted_bytes[:-1]])
                g["E"][k, sorted_bytes[first]] += np.add.reduceat(d_pre[k][order], first, axis=0)
            down = down * update + d_own @ U.transpose(0, 2, 1)
            after = state
        g["E"] = g["E"][:, :END]
        return loss, g

    def train(self, data: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> list[float]:
        """Adam with clipped gradients; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        total = max(1, epochs * -(-len(data) // batch))
        for _ in range(epochs):
            order, sums = rng.permutation(len(data)), []
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                loss, g = self.gradient(data[rows], labels[rows], weights[rows])
                sums.append(loss)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                scale = min(1.0, 1.0 / (norm + 1e-9))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, x in g.items():
                    x *= scale
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses


@dataclass
class Model:
    langs: list[str]
    network: Network | None
    settings: Settings

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean over every byte position of each text. Empty texts get zeros."""
        s, pad = self.settings, self.settings.context
        sums = np.zeros((len(texts), len(self.langs)))
        spans = []  # (doc, from, to)
        for i, x in enumerate(texts):
            if x:
                n = -(-len(x) // s.chunk)
                size = -(-len(x) // n)
                spans += [(i, k * size, min(len(x), (k + 1) * size)) for k in range(n) if k * size < len(x)]
        spans.sort(key=lambda z: z[2] - z[1])
        for at in range(0, len(spans), s.lanes):
            part = spans[at : at + s.lanes]
            wide = max(b - a for _, a, b in part) + 2 * pad
            data = np.zeros((len(part), wide), np.uint8)
            inside = np.zeros((len(part), wide), np.float32)
            lengths = np.empty(len(part), np.int64)
            for k, (i, a, b) in enumerate(part):
                lo = max(0, a - pad)
                body = texts[i][lo : b + pad]
                lengths[k] = len(body)
                data[k, : len(body)] = np.frombuffer(body, np.uint8)
                inside[k, a - lo : b - lo] = 1
            # Languages before lanes: sums over a few languages are then sums of long rows.
            prob = self.network.soft(np.ascontiguousarray(self.network.logits(data, lengths).transpose(0, 2, 1)), 1)
            prob *= inside.T[:, None]
            np.add.at(sums, [i for i, _, _ in part], prob.sum(0, dtype=np.float64).T)
        return sums / np.maximum(1, [len(x) for x in texts])[:, None]


def windows(text: bytes, settings: Settings) -> list[bytes]:
    """Evenly spread training windows of one text."""
    size, n = settings.window, min(settings.windows_per_doc, max(1, len(text) // settings.window))
    room = max(0, len(text) - size)
    return [text[a : a + size] for a in (room * k // max(1, n - 1) for k in range(n))]


def fit(rows: list[tuple[str, bytes]], settings: Settings = Settings()) -> Model:
    """Learn from (lang, text) pairs."""
    rows = [(a, b) for a, b in rows if a is not None and b]
    langs = sorted({a for a, _ in rows})
    if not langs:
        return Model([], None, settings)
    cuts = [(langs.index(a), w) for a, b in rows for w in windows(b, settings)]
    data = np.zeros((len(cuts), settings.window), np.uint8)
    weights = np.zeros((len(cuts), settings.window), np.float32)
    for k, (_, w) in enumerate(cuts):
        data[k, : len(w)] = np.frombuffer(w, np.uint8)
        weights[k, : len(w)] = 1
    network = Network(len(langs), settings.hidden, settings.seed)
    epochs = max(settings.epochs, -(-settings.least_steps // -(-len(cuts) // settings.batch)))
    network.train(data, np.array([a for a, _ in cuts]), weights, epochs, settings.batch, settings.rate, settings.seed)
    return Model(langs, network, settings)


def training_rows(docs: DataFrame, settings: Settings, id_col: str = "doc_id") -> list[tuple[str, bytes]]:
    """At most ``docs_per_lang`` rows of each language, spread by a hash of the id, cut into their training windows."""
    rows = docs.select("lang", F.col(id_col).alias("id"), "text").where("lang is not null and text is not null and length(text) > 0")
    ids = bounded_sample(rows.select("lang", "id"), "lang", settings.docs_per_lang).select(F.col("id").alias("own_id"), F.col("lang").alias("own_lang"))
    # Language and id come first without the texts; the ids sent out are bounded by the sample.
    same = (F.col("lang") == F.col("own_lang")) & F.col("id").eqNullSafe(F.col("own_id"))
    chosen = rows.join(F.broadcast(ids), same, "left_semi")
    # ``windows`` reads no more than this many evenly spread characters' worth of a text, so send just those.
    size, n = settings.window, settings.windows_per_doc
    room = F.greatest(F.lit(0), F.length("text") - size)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.col("text"), (room * k / max(1, n - 1)).cast("int") + 1, F.lit(size)))
    return [(r[0], x.encode()) for r in chosen.select("lang", F.array_distinct(cuts)).orderBy("lang", F.xxhash64("id"), "id").collect() for x in r[1]]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    held = Held(docs.sparkSession, model)  # a few ten thousand floats

    def run(batches):
        own = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), 1024):
                part = texts[at : at + 1024]
                known = [bool(own.langs) and x is not None and any(map(str.isalpha, x)) for x in part]
                found = own.probabilities([x.encode() if ok else b"" for x, ok in zip(part, known, strict=True)]) if own.langs else np.zeros((len(part), 1))
                best = found.argmax(1)
                langs += [own.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                scores += [min(1.0, float(p)) if ok else 0.0 for p, ok in zip(found.max(1), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(frugal(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learned(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the documents that are not held out (crc32 of the id modulo 3 is not 1)."""
    return fit(training_rows(docs.where(crc32_of_id("doc_id") % 3 != 1), settings), settings)


def keep_identified(docs: DataFrame, settings: Settings = Settings(), least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose language is found with a probability of ``least`` or more, with all their columns."""
    held = Held(docs.sparkSession, learned(docs, settings))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        own = held.value
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for lo in range(0, len(texts), 1024):
                part = texts[lo : lo + 1024]
                known = [bool(own.langs) and x is not None and any(map(str.isalpha, x)) for x in part]
                found = own.probabilities([x.encode() if ok else b"" for x, ok in zip(part, known, strict=True)]) if own.langs else np.zeros((len(part), 1))
                keep += [ok and p >= least for ok, p in zip(known, found.max(1), strict=True)]
            yield batch.filter(pa.array([bool(x) for x in keep]))

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # names may hold dots
    return plain.mapInArrow(frugal(run), plain.schema).toDF(*names)


def op3_langid(spark, sf_dir):
    from strictpast.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learned(docs))
    return found.select("doc_id", (crc32_of_id("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score")
