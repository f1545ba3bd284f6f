"""Exact deduplication by a tree-merge of sorted digest runs.

1. Every row gets the SHA-256 of its text without white space, that text's length and a second
   64-bit hash; two rows are equal only if all three agree (the *verification* of each merge).
2. Each partition sorts its rows to runs of distinct digests: a digest's entry carries the
   smallest identifier so far (most code points, then smallest id) and the number of rows.
3. Partitions exchange runs in binomial rounds. Three rounds are done in one exchange: the runs
   whose numbers agree but for their lowest three bits meet and are merged eight ways. A run is
   cut by digest prefix before it is sent, and the number of cuts grows eightfold with each
   exchange, so that a task never holds more than a few ten thousand entries. A digest that a
   third of all rows share is one entry a run from the start. What merges also deals its result
   out for the next exchange: a task never needs a second Python worker, which would stay.
4. The last runs name each digest's row that stays; a join by digest tells every row. Spark
   splits the hot side of this join (adaptive skew join).

Defined cases: a null text counts as empty and all empty texts are equal; a null id sorts after
all ids; fully repeated rows are ties, of which exactly one (by a fixed row number) is kept; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BLANKS, materialise, table

#: Runs merged in one exchange: 2 ** ROUNDS.
ROUNDS = 3
#: Rows after which a partition closes a run, into how many prefix ranges such a run is cut, and into how many any is.
RUN_ROWS, RUN_CUTS, MOST_CUTS = 1 << 18, 8, 1 << 48

ENTRY = np.dtype([
    ("d0", "u8"), ("d1", "u8"), ("d2", "u8"), ("d3", "u8"), ("bytes", "i8"), ("check", "i8"),
    ("short", "i8"), ("no_id", "i1"), ("id", "i8"), ("uid", "i8"), ("rows", "i8"),
])
IDENTITY = ["d0", "d1", "d2", "d3", "bytes", "check"]
RANK = ["short", "no_id", "id", "uid"]
PIECES = "run long, cut long, entries binary"
OPENED = "digest binary, bytes long, check long, keep_id long, keep_uid long, group_size long"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, code points of the text, SHA-256, length and second hash of the normalised text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.char_length(body).cast("long").alias("points"), _bare(body).alias("bare")).select(
        "doc_id", "points", F.unhex(F.sha2("bare", 256)).alias("digest"), F.octet_length("bare").cast("long").alias("bytes"), F.xxhash64("bare").alias("check")
    )


def _bare(body):
    for blank in BLANKS:
        body = F.replace(body, F.lit(blank), F.lit(""))
    return body


def _merge(entries: np.ndarray) -> np.ndarray:
    """Sort, and of entries with one verified identity retain the smallest, with all their rows."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort([entries[k] for k in reversed(IDENTITY + RANK)])]
    new = np.ones(len(entries), bool)
    new[1:] = np.logical_or.reduce([entries[k][1:] != entries[k][:-1] for k in IDENTITY])
    first = np.flatnonzero(new)
    out = entries[first].copy()
    out["rows"] = np.add.reduceat(entries["rows"], first)
    return out


def _cut(run: np.ndarray, cuts: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a sorted run by digest prefix; ``cuts`` is a power of two."""
    bits = cuts.bit_length() - 1
    part = (run["d0"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(run), np.int64)
    for i in range(0, len(starts := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(run) else np.empty(0, int))):
        end = starts[i + 1] if i + 1 < len(starts) else len(run)
        yield int(part[starts[i]]), run[starts[i] : end].tobytes()


def tree_merge(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest: digest, bytes, check, keep_id, keep_uid, group_size.

    ``rows`` has the columns of ``digests`` and a row number ``uid``; it must be materialised.
    """
    partitions = rows.rdd.getNumPartitions()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId(), [], 0

        def close():
            nonlocal number, held, count
            pieces = list(_cut(_merge(np.concatenate(held)), RUN_CUTS))
            run, number, held, count = number, number + partitions, [], 0
            return pa.RecordBatch.from_arrays([pa.array([run] * len(pieces), pa.int64()), pa.array([p for p, _ in pieces], pa.int64()), pa.array([b for _, b in pieces], pa.binary())], names=["run", "cut", "entries"])

        for batch in batches:
            held.append(_entries(batch))
            count += batch.num_rows
            if count >= RUN_ROWS:
                yield close()
        if count:
            yield close()

    level = materialise(rows.select("doc_id", "points", "digest", "bytes", "check", "uid").mapInArrow(runs, PIECES), "dedup-runs")
    last = level.agg(F.max("run")).first()[0] or 0
    if not last:
        return level.select("entries").mapInArrow(_open, OPENED)
    cuts = RUN_CUTS << ROUNDS
    level = level.select("run", "entries").mapInArrow(_deal(cuts), PIECES)
    while last := last >> ROUNDS:
        cuts = min(cuts << ROUNDS, MOST_CUTS)
        level = _exchange(level, cuts)
    return _exchange(level, None)


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, ENTRY)
    doc_id, points, digest, size, check, uid = batch.columns
    words = np.frombuffer(b"".join(digest.to_pylist()), ">u8").reshape(-1, 4)
    for i in range(4):
        out[f"d{i}"] = words[:, i]
    out["no_id"] = doc_id.is_null().to_numpy(zero_copy_only=False)
    out["id"] = doc_id.fill_null(0).to_numpy()
    out["short"], out["bytes"], out["check"], out["uid"], out["rows"] = -points.to_numpy(), size.to_numpy(), check.to_numpy(), uid.to_numpy(), 1
    return out


def _deal(cuts: int):
    """Pieces of runs as the next exchange needs them: cut finer, under the number that their run will have."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, entries in zip(batch.column("run").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                yield _dealt(run, np.frombuffer(entries, ENTRY), cuts)

    return deal


def _dealt(run: int, entries: np.ndarray, cuts: int) -> pa.RecordBatch:
    part, piece = zip(*_cut(entries, cuts), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([run >> ROUNDS] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(piece, pa.binary())], names=["run", "cut", "entries"])


def _exchange(level: DataFrame, cuts: int | None) -> DataFrame:
    """2 ** ROUNDS runs at a time become one; its pieces are dealt out again, in ``cuts``, or opened if it is the last."""

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        merged = _merge(np.concatenate([np.frombuffer(x, ENTRY) for x in pieces.column("entries").to_pylist()]))
        return pa.Table.from_batches([_opened(merged) if cuts is None else _dealt(key[0].as_py(), merged, cuts)])

    return level.groupBy("run", "cut").applyInArrow(merge, OPENED if cuts is None else PIECES)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entries in batch.column("entries").to_pylist():
            yield _opened(np.frombuffer(entries, ENTRY))


def _opened(run: np.ndarray) -> pa.RecordBatch:
    words = np.stack([run[f"d{i}"] for i in range(4)], axis=1).astype(">u8").tobytes()
    digest = [words[i : i + 32] for i in range(0, len(words), 32)]
    return pa.RecordBatch.from_arrays(
        [pa.array(digest, pa.binary()), pa.array(run["bytes"]), pa.array(run["check"]), pa.array(run["id"], mask=run["no_id"].astype(bool)), pa.array(run["uid"]), pa.array(run["rows"])],
        names=["digest", "bytes", "check", "keep_id", "keep_uid", "group_size"],
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digests(docs, doc_id, text).withColumn("uid", F.monotonically_increasing_id()), "dedup-digests")
    kept = tree_merge(rows)
    return rows.join(kept, ["digest", "bytes", "check"]).select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by digest and id. Where the row that stays is itself repeated (same id,
    same text), the repetitions meet in one small extra exchange and the first in order stays.
    """
    rows = materialise(digests(docs, doc_id, text).withColumn("uid", F.monotonically_increasing_id()), "dedup-digests")
    best = tree_merge(rows)
    twins = (
        rows.join(best.select("digest", "bytes", "check", "keep_id"), ["digest", "bytes", "check"])
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest", "keep_id")
        .agg(F.max("points").alias("points"), F.count("*").alias("rows"))
    )
    stay = materialise(twins, "dedup-stay")
    # Whole rows travel as one column, so that no name of theirs can clash.
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.struct("*").alias("doc"), F.unhex(F.sha2(_bare(body), 256)).alias("d"), F.char_length(body).cast("long").alias("p"), F.col(doc_id).cast("long").alias("i"))
    found = found.join(stay, (F.col("d") == F.col("digest")) & F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("p") == F.col("points")))
    return found.where("rows = 1").select("doc.*").unionByName(found.where("rows > 1").dropDuplicates(["digest"]).select("doc.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST) AS place FROM d)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY place) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       place = 1 AS kept, text_sha256
FROM r
"""
