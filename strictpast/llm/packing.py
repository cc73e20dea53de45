"""Best-fit packing planned on the histogram of piece lengths.

Documents become token ids and an end id, cut into pieces of at most ``capacity`` ids. Pieces of each length are
counted; best-fit decreasing places counts, not pieces, so the plan has at most a few rows per length; each piece then
takes the planned slot of its rank within its length. Ranks are exact over any number of rows: a length's pieces are
spread over salts, ranked inside a salt and shifted by the salts before it.

A null or empty text is the end id alone. Repeated rows are packed each. A null id is packed as it is. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from strictpast.llm.common import Held, frugal, once_a_process, written

#: A length of n pieces has about sqrt(n) / SALT salts of SALT * sqrt(n) pieces each: neither the salts of a length,
#: which are summed in one task, nor the pieces of a salt grow as the length does.
SALT = 4


class WordTokens:
    """Token ids as little-endian bytes, by a tokenizer whose words never cross ASCII white space.

    A bounded memory of words spares most calls; both generations of it are dropped in turn.
    """

    #: Bytes that end words and form a token run of their own after an ASCII letter or digit. No apostrophe: it begins contractions.
    TAIL = b".,!?%&$*#;:)"

    def __init__(self, path: str, size: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.size = Tokenizer.from_file(path), size
        # Lower-case letters in composed form pass the tokenizer's normalizer and splitter unchanged, one word each.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        #: Added tokens are found in a text before it is lower-cased, so lower-casing must not make one.
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _fetch(self, words: list[bytes]) -> None:
        plain, names, other = [], [], []
        for word in words:
            text = word.decode()
            if text.isalpha() and text.islower() and (text.isascii() or is_normalized("NFC", text)):
                plain.append(text)
                names.append(word)
            else:
                other.append(word)
        for at in range(0, len(plain), 1000):
            ids = np.array(self.letters.encode_batch_fast([" ".join(plain[at : at + 1000])], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            raw, part = ids.tobytes(), names[at : at + 1000]
            if len(cuts) == len(part) + 1:
                self.young.update(zip(part, (raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))
            else:  # a vocabulary without word ends for some letter
                other += part
        if other:
            found = self.tokenizer.encode_batch_fast([x.decode() for x in other], add_special_tokens=False)
            for word, ids in zip(other, found, strict=True):
                self.young[word] = np.array(ids.ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Have all ``words`` in memory."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for word in words:
            if word in old:
                young[word] = old[word]
            elif word not in young:
                missing.append(word)
        parts, need = [], set()
        for word in missing:
            core = word.rstrip(self.TAIL)
            low = core.lower()
            if low != core and any(x in low for x in self.added):
                need.add(word)
            # Lower case is the tokenizer's own first step; a tail after an ASCII letter or digit is a run of its own.
            elif len(core) == len(word):
                if low != word:
                    parts.append((word, low, b""))
                need.add(low)
            elif core and core[-1:].isalnum():
                tail = word[len(core) :]
                parts.append((word, low, tail))
                need.add(low)
                need.add(tail)
            else:
                need.add(word)
        absent = []
        for x in need:
            if x in old:
                young[x] = old[x]
            elif x not in young:
                absent.append(x)
        if absent:
            self._fetch(absent)
        for word, low, tail in parts:
            young[word] = young[low] + young[tail] if tail else young[low]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        out: list = []
        late: list[tuple[int, list, list[int], list[bytes]]] = []
        missing: set[bytes] = set()

        def settle() -> None:
            self.learn(missing)
            young = self.young
            for at, got, holes, names in late:
                for i, w in zip(holes, names, strict=True):
                    got[i] = young[w]
                out[at] = b"".join(got)
            late.clear()
            missing.clear()

        for text in texts:
            words = (text or b"").split()
            got = list(map(self.young.get, words))
            holes, i = [], -1
            try:
                while True:
                    i = got.index(None, i + 1)
                    holes.append(i)
            except ValueError:
                pass
            if holes:
                names = [words[i] for i in holes]
                missing.update(names)
                late.append((len(out), got, holes, names))
                out.append(b"")
                if len(missing) > 20_000:
                    settle()
            else:
                out.append(b"".join(got))
        settle()
        return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids: little-endian unsigned 32-bit])."""

    def run(batches):
        words = once_a_process(f"words {tokenizer_path}", lambda: WordTokens(tokenizer_path))
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = defaultdict(list)
                for name, body in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    body += last
                    for k, at in enumerate(range(0, len(body), 4 * capacity)):
                        piece = body[at : at + 4 * capacity]
                        for key, value in (("id", name), ("piece", k), ("start", at // 4), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece))):
                            rows[key].append(value)
                        if with_ids:
                            rows["ids"].append(piece)
                kinds = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in rows.items()], list(rows))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(frugal(run, f"words {tokenizer_path}"), "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, sequences, per sequence, first sequence, offset).

    Rows of the plan hold ``sequences * per sequence`` pieces of one length; rank r of them goes to sequence
    ``first + r // per`` at ``offset + r % per * length``. Sequences that are alike form one range, so a step takes a
    whole range or splits it once.
    """
    slots, total = [], 0
    spaces: list[int] = []  # remaining spaces that occur, ascending
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space -> (first sequence, sequences)

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if not ranges[space]:
                insort(spaces, space)
            ranges[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = ranges[space].pop()
                if not ranges[space]:
                    del spaces[at]
            else:
                space, first, count = capacity, total, -(-left // (capacity // length))
                total += count
            per = min(space // length, left)
            use = min(count, left // per)
            slots.append((length, rank, use, per, first, capacity - space))
            rank, left = rank + use * per, left - use * per
            put(space - per * length, first, use)
            put(space, first + use, count - use)
    return slots


def place(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with id, piece and length; sequences are gapless from offset 0."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = plan(counts, capacity)
    many = spark.createDataFrame([(k, max(1, round(v**0.5 / SALT))) for k, v in counts.items()], "length long, salts int")
    salted = found.join(F.broadcast(many), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece"))
    ranked = salted.withColumn("inside", inside).join(shift, ["length", "salt"]).withColumn("rank", (F.col("inside") - 1 + F.col("shift")).cast("long")).drop("inside", "shift", "salt")
    table = np.array(slots, np.int64).reshape(-1, 6)
    order = np.lexsort((table[:, 1], table[:, 0]))
    held = Held(spark, table[order])  # bounded by the plan, which is bounded by the lengths

    def run(batches):
        plan_rows = held.value
        wide = np.int64(1) << 44
        keys = plan_rows[:, 0] * wide + plan_rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = plan_rows[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            own = rank - slot[:, 1]
            sequence, offset = slot[:, 4] + own // slot[:, 3], slot[:, 5] + own % slot[:, 3] * length
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)], [batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(frugal(run), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    found = written(pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pieces")
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return place(found, capacity).select(F.col("id").alias(id_col), *names)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from ``pack(with_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    return parts.select("sequence_id", F.unhex(F.array_join(F.col("parts.ids"), "")).alias("ids"))


def op2_packing(spark, sf_dir):
    import public_tokenizers

    from strictpast.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
