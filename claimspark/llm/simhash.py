"""SimHash near-duplicates with pigeonring filtering.

A text's 64-bit fingerprint has each bit that is set in over half the hashes of its word
shingles. Fingerprints at ``DISTANCE`` (3) or fewer differing bits are linked, documents of linked
fingerprints form components.

*Pigeonring.* The 64 bits are a ring of four segments of 16. If at most 3 bits differ in all, then
from some segment on the differences of every chain of 1, 2, 3, 4 consecutive segments stay within
its proportional share of the budget (0, 1, 2, 3). So for a start i, segment i is equal and segment
i+1 differs in one bit at most, which leaves one of its two halves equal: each fingerprint is filed
under eight keys of 24 bits (start, half, the 16 and the 8 bits). Pairs under a key must pass the
chains of two and three segments before all 64 bits are compared.

Distinct fingerprints are filed, not documents, so copies cost nothing. A task reads its keys in
order, holds the fingerprints of a few keys, and reports for each key a forest, not all pairs. A
key with over ``CROWD`` fingerprints is refiled under itself and one of four segments of another
cut of the ring (one must be equal), twice if need be. What is crowded even then is a dense ball;
it is cut to blocks, and each pair of blocks is a key of its own: exact at any size, in bounded
memory.

Defined cases: a null text counts as empty; without words the fingerprint is zero, linked like any
other; a null id is carried and counts for a component's smallest id only if all its ids are null;
repeated rows get repeated results; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table, utf8
from .components import components

SHINGLE, SEED, DISTANCE, CROWD, REFINE = 3, 42, 3, 16_384, 2
#: Ids that several rows share are sent to the executors up to this many, beyond that they are joined by a shuffle.
MAX_SENT = 200_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a UTF-8 text, in which A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(map(fingerprint, utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def ring_keys(nodes: DataFrame) -> DataFrame:
    """key, fingerprint: the eight keys of each. Bits 25-26 of a key are the start, bit 24 is the half."""
    keys = []
    for i in range(4):
        first = F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(0xFFFF)
        second = F.shiftrightunsigned("fingerprint", 16 * ((i + 1) % 4)).bitwiseAND(0xFFFF)
        for half in range(2):
            keys.append(F.lit((2 * i + half) << 24) + first * 256 + F.shiftright(second, 8 * half).bitwiseAND(0xFF))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")


def refiled(crowded: DataFrame, turn: int) -> DataFrame:
    """Each crowded key's rows under that key and each of the four segments of the ring turned on."""
    parts = []
    turned = F.col("fingerprint")
    by = 8 * turn % 16 + turn
    if by:
        turned = F.shiftleft(turned, by).bitwiseOR(F.shiftrightunsigned(turned, 64 - by))
    for i in range(4):
        parts.append(F.xxhash64(F.col("key"), F.lit(4 * turn + i), F.shiftrightunsigned(turned, 16 * i).bitwiseAND(0xFFFF)))
    return crowded.select(F.explode(F.array(*parts)).alias("key"), "fingerprint")


def linked(a: np.ndarray, b: np.ndarray, key: np.ndarray, ring: bool) -> np.ndarray:
    """Which pairs differ in DISTANCE bits at most; with ``ring``, chains of segments are tried first."""
    diff = a ^ b
    if ring:
        turn = ((key >> 25).astype(np.uint64) & np.uint64(3)) * np.uint64(16)
        chain = (diff >> turn) | np.where(turn > 0, diff << ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
        hold = (np.bitwise_count(chain & np.uint64(0xFFFFFFFF)) <= 1) & (np.bitwise_count(chain & np.uint64(0xFFFFFFFFFFFF)) <= 2)
        hold[hold] = np.bitwise_count(diff[hold]) <= DISTANCE
        return hold
    return np.bitwise_count(diff) <= DISTANCE


def forest(keys: np.ndarray, prints: np.ndarray, ring: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, under each key, what its pairs connect. Rows of a key stand together."""
    parent = np.arange(len(keys))
    at = np.arange(len(keys))
    for step in range(1, len(keys)):
        at = at[: np.searchsorted(at, len(keys) - step)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        hit = at[linked(prints[at], prints[at + step], keys[at], ring)]
        a, b = parent[hit], parent[hit + step]
        while len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(parent, high, low)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            a, b = parent[a], parent[b]
            a, b = a[a != b], b[a != b]
    child = np.flatnonzero(parent != np.arange(len(keys)))
    return prints[child], prints[parent[child]]


def blocks(crowded: DataFrame) -> DataFrame:
    """Each crowded key's rows dealt to blocks, and a key for each pair of blocks."""
    sizes = crowded.groupBy("key").agg(F.ceil(F.count("*") * 2 / CROWD).cast("long").alias("n"))
    dealt = crowded.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fingerprint"), "n"))
    paired = dealt.select("key", "fingerprint", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return paired.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fingerprint")


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints, enough to connect all that are linked."""
    keys, out = ring_keys(nodes), []
    for turn in range(REFINE + 2):
        last = turn > REFINE
        pairs = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_pair_up(ring=not turn, crowd=1 << 62 if last else CROWD), "key long, a long, b long")
        out.append(materialise(pairs, "simhash-links"))
        crowded = out[-1].where("key is not null").select("key", F.col("a").alias("fingerprint"))
        if last or crowded.isEmpty():
            break
        keys = refiled(crowded, turn + 1) if turn < REFINE else blocks(crowded)
    return reduce(DataFrame.union, (x.where("key is null").select("a", "b") for x in out))


def _pair_up(ring: bool, crowd: int):
    def emit(key: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if key is None else pa.array(key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            held_keys = np.concatenate([held_keys, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(held):
                continue
            if hot is not None:  # more rows of a key that is crowded
                n = np.searchsorted(held_keys, hot, "right")
                if n:
                    yield emit(held_keys[:n], held[:n], held[:n])
                if n == len(held):
                    held_keys, held = held_keys[:0], held[:0]
                    continue
                held_keys, held, hot = held_keys[n:], held[n:], None
            # The last key may go on in the next batch.
            n = np.searchsorted(held_keys, held_keys[-1], "left")
            yield from settle(held_keys[:n], held[:n])
            held_keys, held = held_keys[n:], held[n:]
            if len(held) > crowd:
                hot = held_keys[-1]
                yield emit(held_keys, held, held)
                held_keys, held = held_keys[:0], held[:0]
        yield from settle(held_keys, held)

    def settle(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        many = np.repeat(sizes > crowd, sizes)
        if many.any():
            yield emit(keys[many], prints[many], prints[many])
        some = np.repeat((sizes > 1) & (sizes <= crowd), sizes)
        a, b = forest(keys[some], prints[some], ring)
        if len(a):
            yield emit(None, a, b)

    return run


def rooted_prints(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id and fingerprint of each row; each distinct fingerprint, its least id and its component's root)."""
    rows = materialise(fingerprints(docs, doc_id, text), "simhash-prints")
    nodes = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fingerprint")))
    return rows, nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (long), component_id."""
    rows, rooted = rooted_prints(docs, doc_id, text)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each component: one with its smallest id, null only if all are.

    Components are told apart by their root, as ids may be null or shared. What stays is found
    again by its id where one row has it, otherwise by id and fingerprint; of rows that share
    both, one stays.
    """
    rows, rooted = rooted_prints(docs, doc_id, text)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fingerprint")).alias("best")
    stay = materialise(rooted.groupBy("root").agg(best).select(F.col("best.least").alias("id"), F.col("best.fingerprint").alias("print")), "simhash-stay")
    ids = materialise(rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")), "simhash-ids")
    # Whole rows travel as one column, so that no name of theirs can clash.
    whole = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    alone = whole.join(stay.join(ids.where("rows = 1"), "id").select("id"), F.col("i") == F.col("id")).select("doc")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.fromiter(map(fingerprint, utf8(batch.column(1))), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine), batch.column(2)], names=["i", "mine", "doc"])

    several = ids.where("rows > 1").select("id")
    if several.limit(MAX_SENT + 1).count() <= MAX_SENT:
        several = F.broadcast(several)
    shared = whole.join(several, F.col("i") == F.col("id"), "left_semi").unionByName(whole.where("i is null")).select("i", "t", "doc")
    again = shared.mapInArrow(printed, shared.select("i", F.lit(0).cast("long").alias("mine"), "doc").schema)
    again = again.join(stay, (F.col("mine") == F.col("print")) & F.col("i").eqNullSafe(F.col("id"))).dropDuplicates(["print"])
    return alone.select("doc.*").unionByName(again.select("doc.*"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
