"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Texts become ids of a given tokenizer file, then an end id. White space separates words for
   this tokenizer, so each word is encoded once and its ids are kept in a bounded cache. Ids
   longer than a sequence are cut to pieces of full length; only the last piece is shorter.
2. A full piece is a sequence. The others are dealt to groups of about ``GROUP`` pieces by a hash,
   and each group is packed best-fit decreasing: a segment tree over remaining capacities finds
   the tightest open sequence in logarithmic time.
3. What stands in sequences that a group left with an eighth or more free is gathered and packed
   once more, over fewer and fewer groups, until one is left or it no longer helps.

Only lengths are packed, never ids, so a group needs a few MB.

Defined cases: a null text counts as empty, and an empty text is its end id; a repeated row is
packed again; a null id is carried; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import gc
import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain, compress
from operator import add
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table, texts

LIMIT, END, GROUP = 4096, 1, 1 << 16
#: Words, and parts of words, that an encoder knows before it lets go of those not just used; 450,000 of both take about 110 MB.
#: Those of more than LONG characters, which may be whole texts, are never kept.
CACHED, LONG = 450_000, 64
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Words are known by heart, and so are the parts to which the tokenizer splits them, so that
    punctuation doesn't make a word new. Unknown parts go to the tokenizer many at a time; the
    last id of each part ends a word, which tells where one part's ids end.
    """

    #: Blank for str.split(), but not for the tokenizer: texts with these are encoded whole.
    ODD = "\x1c\x1d\x1e\x1f"
    #: How the tokenizer splits lower-case words of characters below U+0180, which it takes as they are.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ\u0100-\u017f]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ\u0100-\u017f0-9²³¹¼½¾]+")
    PLAIN = re.compile("[!-~¡-\u017f]+")

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def ask(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            ids = self.ask(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
                self.parts.update((part, data[a:b]) for part, a, b in zip(some, cuts, cuts[1:], strict=False))
            else:
                self.parts.update((part, self.ask(part).tobytes()) for part in some)

    def learn(self, words: set[str]) -> None:
        plain = self.PLAIN.fullmatch
        # Most words are letters, then punctuation or nothing.
        every = list(words)
        cores = [w.rstrip(".,;:!?") for w in every]
        easy = [c.isalpha() and (c.isascii() or plain(c) is not None) for c in cores]
        easy_words, cores = list(compress(every, easy)), list(compress(cores, easy))
        lows, tails = [c.lower() for c in cores], [w[len(c) :] for w, c in zip(easy_words, cores, strict=True)]
        hard = {}
        for word in words.difference(easy_words):
            if "<" not in word and (word.isascii() or plain(word)):
                hard[word] = self.PARTS.findall(word.lower())
            else:
                self.words[word] = self.ask(word).tobytes()
        used = set(chain(lows, tails, *hard.values()))
        self.parts = parts = trimmed(self.parts, used)
        self.learn_parts(list(used.difference(parts)))
        self.words.update(zip(easy_words, map(add, map(parts.__getitem__, lows), map(parts.__getitem__, tails)), strict=True))
        self.words.update((word, b"".join(map(parts.__getitem__, found))) for word, found in hard.items())
        for part in [p for p in used if len(p) > LONG]:
            del parts[part]

    def encode_all(self, bodies: list[str]) -> Iterator[bytes]:
        """The ids of each text, some at a time."""
        held, size = [], 0
        for body in bodies:
            held.append([body] if any(c in body for c in self.ODD) else body.split())
            size += len(body)
            if size > 2_000_000:
                yield from self.settle(held)
                held, size = [], 0
        yield from self.settle(held)

    def settle(self, texts_: list[list[str]]) -> Iterator[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # it would walk the caches again and again; nothing here makes cycles
        try:
            used = set(chain.from_iterable(texts_))
            self.words = known = trimmed(self.words, used)
            self.learn(new := used.difference(known))
            long = [w for w in new if len(w) > LONG]
            del used, new
        finally:
            if collecting:
                gc.enable()
        for words in texts_:
            yield b"".join(map(known.__getitem__, words))
        for word in long:
            del known[word]


def trimmed(cache: dict[str, bytes], used: set[str]) -> dict[str, bytes]:
    """The cache, or if it has grown beyond ``CACHED`` what of it is used now."""
    return cache if len(cache) <= CACHED else {"": b""} | {x: cache[x] for x in used & cache.keys()}


def encoder_of_worker(path: str | None) -> Encoder:
    """The one encoder of a Python worker: the words it knows serve the worker's later tasks too.

    It is kept in a module of its own, as this one may be sent along anew with each task. What it
    knows stays within ``CACHED``, and ids don't depend on it.
    """
    worker = sys.modules.setdefault("claimspark_worker", ModuleType("claimspark_worker"))
    kept = worker.__dict__.setdefault("encoders", {})
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path)
    return kept[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, uid = encoder_of_worker(path), TaskContext.get().partitionId() << 40
        close = end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for number, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts(batch.column(1))), strict=True):
                ids += close
                for i, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((uid, number, i, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("i4")] if keep_ids else [])))
                    uid += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*kinds, pa.list_(pa.int32())], strict=False)], names=names)

    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities 0..limit: which of them some open sequence has."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = self.size + capacity
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest capacity of at least ``least``, and a sequence that has it, which is removed."""
        some, i = self.any, self.size + least
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        capacity = i - self.size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            some[i] = 0
            i >>= 1
            while i and not (some[2 * i] or some[2 * i + 1]):
                some[i] = 0
                i >>= 1
        return capacity, sequence


def best_fit(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each length, and what each sequence has left. Lengths are 1..limit."""
    sequences, offsets, left = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    tree = Capacities(limit)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity, sequence = tree.take(need) or (limit, len(left))
        if sequence == len(left):
            left.append(limit)
        sequences[i], offsets[i] = sequence, limit - capacity
        left[sequence] = capacity - need
        if capacity > need:
            tree.add(capacity - need, sequence)
    return sequences, offsets, np.array(left, np.int64)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    every = materialise(pieces(docs, doc_id, text, path, limit, end, keep_ids), "pack-pieces")
    light = every.select("uid", "length")

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("uid")
        sequences, offsets, left = best_fit(group.column("length").to_numpy(), limit)
        return pa.table({"uid": group.column("uid"), "length": group.column("length"), "sequence_id": pa.array((key[0].as_py() << 32) + sequences), "offset": pa.array(offsets), "loose": pa.array(8 * left[sequences] >= limit)})

    placed, first, todo = [], 0, light.where(F.col("length") < limit)
    count, before = todo.count(), None
    while count:
        groups = -(-count // GROUP)
        dealt = todo.withColumn("group", F.pmod(F.xxhash64("uid"), groups) + first).repartition(groups, "group")
        done = materialise(dealt.groupBy("group").applyInArrow(fit, "uid long, length long, sequence_id long, offset long, loose boolean"), "pack-placed")
        first, before = first + groups, count
        # Another round helps only if several groups have left something loose, and less than half of all.
        count = done.where("loose").count() if groups > 1 else 0
        if 2 * count > before:
            count = 0
        placed.append(done.where("not loose") if count else done)
        todo = done.where("loose").select("uid", "length")
    full = light.where(F.col("length") == limit).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for done in placed:
        full = full.unionByName(done.select("uid", "sequence_id", "offset"))
    return every.join(full, "uid").drop("uid")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
