"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

*Targets.* The sources, by code point and null last, weigh 5, 2, 1, repeating, and share the total
size. A target stops at three times its source's size and the excess is shared again by weight:
with the sources sorted by size per weight, running sums give the level at which all are served.

*Selection.* A source's target is a number of complete epochs and a rest. Every document has the
exponential key -ln(u) / quality, where u comes from a digest of its id; the smallest keys are a
weighted sample without replacement. Sorted by key within the source, documents are taken while
the prefix sum of sizes is within the rest; the one that crosses it gives its first words, so that
a source's taken words are its target, rounded.

*Scale.* No source is sorted whole. 1 - exp(-key) puts keys into ``BUCKETS`` intervals; only sizes
by (source, interval) are prefix-summed, and only the documents of the one interval of each source
in which the rest runs out are sorted.

Defined cases: a null text has size 0 and is never taken; a source of size 0 has target 0; a
missing or bad quality counts as 1; documents with the same id have the same key and follow each
other by size; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialise, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS, MOST_EPOCHS, BUCKETS = (5, 2, 1), 3, 1 << 12
#: A label of good quality doubles a document's weight, one of bad quality halves it.
QUALITY = {1: 2.0, 0: 0.5}


def count_words(column: pa.Array) -> np.ndarray:
    """Runs of characters other than ASCII white space, for each text of a string column."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    at = offsets - offsets[0]
    solid = (data != 32) & (data - np.uint8(9) > 4)  # BLANKS; an index by bytes would take 8 times the text
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    begins = at[:-1][at[:-1] < at[1:]]  # a text's first character starts a word whatever precedes it
    start[begins] = solid[begins]
    return np.array([np.count_nonzero(start[a:b]) for a, b in pairwise(at.tolist())], np.int64)


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words and a row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(count_words(batch.column(3)), pa.int64())], names=["row", "doc_id", "source", "size"])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "row long, doc_id long, source string, size long")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target. The windows here hold a row for each source, not for each document."""
    every = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    every = every.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    rank = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before, whole = W.orderBy(*rank).rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    onwards = W.orderBy(*rank).rowsBetween(0, W.unboundedFollowing)
    # If all sources before one are at their caps, the others share what is left at this level.
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onwards)
    every = every.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    served = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return every.select("source", "source_size", F.when(F.col("capped"), most * F.col("source_size")).otherwise(served * F.col("weight")).cast("double").alias("target"))


def uniform(doc_id):
    """In (0, 1), from the first 52 bits of a digest of the id; the same at every run."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source, source_size, target, taken, row.

    ``quality``: doc_id and weight; of several weights for an id the largest counts.
    """
    rows = sizes(docs, doc_id, text, source)
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("weight").alias("weight"))
        rows = rows.join(best, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(F.lit(1.0))
    rows = rows.withColumn("key", -F.log(uniform("doc_id")) / weight).drop("weight")
    rows = materialise(rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")), "mix-sizes")

    goal = targets(rows).withColumn("words", F.round("target").cast("long"))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialise(goal.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")), "mix-targets").withColumnRenamed("source", "of")

    # The interval of each source in which its rest runs out, and how much of the rest is left there.
    filled = rows.groupBy("source", "bucket").agg(F.sum("size").alias("filled"))
    filled = filled.withColumn("before", F.coalesce(F.sum("filled").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    edge = filled.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("of")))
    edge = edge.where("before <= rest and rest < before + filled").select("of", F.col("bucket").alias("last"), (F.col("rest") - F.col("before")).alias("left"))
    goal = materialise(goal.join(edge.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of"), "mix-edges")

    told = rows.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("of")))
    out = ["row", "doc_id", "size", "source", "source_size", "target"]
    # Without an edge the rest is 0 and no document is taken in part.
    sure = told.where("last is null or bucket <> last").select(*out, (F.col("epochs") * F.col("size") + F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0)).alias("taken"))
    order = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(W.unboundedPreceding, -1)
    split = told.where("bucket = last").withColumn("used", F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("used")))
    return sure.unionByName(split.select(*out, (F.col("epochs") * F.col("size") + part).alias("taken")))


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    """A table of sources is sent to all executors only if it is known to be small."""
    return sources.limit(most + 1).count() <= most


def label_quality(labels: DataFrame) -> DataFrame:
    weight = F.lit(None).cast("double")
    for label, w in QUALITY.items():
        weight = F.when(F.col("quality") == label, F.lit(w)).otherwise(weight)
    return labels.select("doc_id", weight.alias("weight"))


def apply_mix(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken.

    A document taken in part appears with its first words. ``docs`` must be a table whose rows come
    in the same order whenever it is read.
    """
    taken = mix(docs, quality, doc_id, text, source).where("taken > 0").select(F.col("row").alias("at"), "size", "taken")
    # Whole rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"), F.struct("*").alias("doc"))
    copies = rows.join(taken, F.col("row") == F.col("at")).withColumn("copy", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    copies = copies.withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [first_words(t, n) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.set_column(1, batch.schema.field(1), pa.array(bodies, batch.schema.field(1).type))

    part = copies.where("words < size").select("words", "t", "doc")
    part = part.mapInArrow(cut, part.schema).select(F.col("doc").withField(f"`{text}`", F.col("t")).alias("doc"))
    return copies.where("words = size").select("doc.*").unionByName(part.select("doc.*"))


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    for i, m in enumerate(WORD.finditer(text)):
        if i + 1 == n:
            return text[: m.end()]
    return text


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, label_quality(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END) AS weight FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / coalesce(q.weight, 1.0)::DOUBLE AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM k GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s),
t AS (
  SELECT source, source_size,
         CAST(CASE WHEN level * weight >= 3 * source_size THEN 3 * source_size
              ELSE max(CASE WHEN level * weight < 3 * source_size THEN level END) OVER () * weight END AS DOUBLE) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
u AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(round(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - used)) AS BIGINT) AS taken FROM u
"""
