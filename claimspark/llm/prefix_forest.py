"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``TREES`` trees gives a vector a string of ``DEPTH`` bits, the signs of random projections
beside their medians, and is a sorted array of these strings. A query descends to its longest
prefix matches by binary search, then ascends in all trees at once: one bit less on each level
admits more candidates, whose distances are computed exactly.

It stops where the neighbours found are probably all: if two vectors as far apart as the tenth
best candidate agree in a bit with chance p, the chance that no tree would have brought them
together on this level, (1 - p^level)^TREES, is under ``MISS``. p as a function of the distance, and
the medians, are fitted on a sample of ``SAMPLE`` vectors; every vector is indexed. So clustered
data stop deep in the trees, and data without structure climb near the roots.

*Scale.* The forest is built in blocks of ``BLOCK`` vectors, as a search engine keeps segments; the
queries, in blocks too, visit all of them, and each brings back its ten best from each block.

Defined cases: vectors that are null, zero, hold null or non-finite components, have a null id or
another length than most take no part; equal distances go by the smaller vec_id; of rows with the
same id each is a query or candidate of its own; with fewer candidates than asked for all are
given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import Sent, few_by_hash, materialise, table

TREES, DEPTH, MISS, SAMPLE, BLOCK, QUERY_BLOCK, NEIGHBOURS = 32, 24, 0.03, 2048, 16_384, 20_000, 10


class Hashing:
    """Random projections with medians, and the chance that a bit agrees at a distance."""

    def __init__(self, sample: np.ndarray, seed: int = 20_240):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(sample.shape[1], TREES * DEPTH)).astype(np.float32)
        projected = sample.astype(np.float32) @ self.directions
        self.medians = np.median(projected, axis=0)
        self.fit(sample, projected > self.medians)

    def fit(self, sample: np.ndarray, bits: np.ndarray) -> None:
        """Mean agreement in bins of distance, never rising with it; 1 at distance 0."""
        n = len(sample)
        i, j = np.random.default_rng(1).integers(0, n, (2, 40_000))
        near = [k for k in range(min(n, 128)) for _ in range(8)]
        first = sample[near[::8]].astype(float)
        all_distances = np.sqrt(np.maximum(0, (first**2).sum(1)[:, None] + (sample.astype(float) ** 2).sum(1) - 2 * first @ sample.astype(float).T))
        closest = np.argsort(all_distances, axis=1)[:, 1:9]
        i = np.r_[i, np.repeat(np.arange(len(closest)), closest.shape[1])]
        j = np.r_[j, closest.ravel()]
        distance = np.sqrt(((sample[i].astype(float) - sample[j]) ** 2).sum(axis=1))
        agree = np.empty(len(i))
        for at in range(0, len(i), 4096):
            agree[at : at + 4096] = (bits[i[at : at + 4096]] == bits[j[at : at + 4096]]).mean(axis=1)
        order = np.argsort(distance)
        bins = np.array_split(order, min(64, len(order)))
        # The rarest, smallest distances matter most: small bins there.
        bins = [*np.array_split(order[:512], 16), *bins[1:]] if len(order) > 2048 else bins
        self.distance = np.r_[0.0, [distance[b].mean() for b in bins]]
        self.agreement = np.minimum.accumulate(np.r_[1.0, [agree[b].mean() for b in bins]])
        keep = np.argsort(self.distance, kind="stable")
        self.distance, self.agreement = self.distance[keep], np.minimum.accumulate(self.agreement[keep])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Trees by vectors: the bit strings as integers, the first bit highest."""
        bits = (x.astype(np.float32) @ self.directions > self.medians).reshape(len(x), TREES, DEPTH)
        return (bits @ (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))).T.copy()

    def enough(self, distance: np.ndarray) -> np.ndarray:
        """The deepest level at which neighbours at this distance are missed rarely enough."""
        p = np.clip(np.interp(distance, self.distance, self.agreement), 1e-6, 1 - 1e-9)
        each = 1 - MISS ** (1 / TREES)  # the chance that a single tree must give
        return np.clip(np.floor(np.log(each) / np.log(p)), 0, DEPTH).astype(int)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


class Forest:
    """Sorted arrays of one block of vectors."""

    def __init__(self, hashing: Hashing, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.hashing, self.x, self.ids, self.rows = hashing, x, ids, rows
        codes = hashing.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Trees by queries: where the strings that share so many bits with the query's begin and end."""
        shift = DEPTH - level
        low = codes >> shift << shift
        begin, end = np.empty(codes.shape, int), np.empty(codes.shape, int)
        for t in range(TREES):
            begin[t] = np.searchsorted(self.sorted[t], low[t], "left")
            end[t] = np.searchsorted(self.sorted[t], low[t] + (1 << shift), "left")
        return begin, end

    def search(self, queries: np.ndarray, rows: np.ndarray, k: int = NEIGHBOURS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, vector numbers, distances), at most k, nearest first."""
        codes = self.hashing.codes(queries)
        want = min(k, len(self.x))
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        level = np.full(len(queries), -1)
        for depth in range(DEPTH, -1, -1):  # descend: the longest prefix with candidates enough to start from
            ranges[depth] = begin, end = self.ranges(codes, depth)
            level[(level < 0) & (((end - begin).sum(axis=0) >= 2 * k) | (depth == 0))] = depth
        mark = np.zeros(len(self.x), bool)
        for i, q in enumerate(queries):
            depth = int(level[i])
            while True:  # ascend
                begin, end = ranges[depth][0][:, i], ranges[depth][1][:, i]
                mark[:] = False
                for t in range(TREES):
                    mark[self.order[t, begin[t] : end[t]]] = True
                found = np.flatnonzero(mark)
                found = found[self.rows[found] != rows[i]]
                far = distances(self.x[found], q)
                best = np.lexsort((self.ids[found], far))[:k]
                if depth == 0 or len(best) >= want and (stop := int(self.hashing.enough(far[best[-1]]))) >= depth:
                    break
                depth = depth - 1 if len(best) < want else max(0, min(depth - 1, stop))
            yield i, found[best], far[best]


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (doubles) and a row number of the vectors that take part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), F.monotonically_increasing_id().alias("row"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(whole, F.lit(False)))


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = materialise(valid(vectors, vec_id, embedding), "forest-vectors")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_row long, query_id long, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == size.d)
    sample = np.array([r.x for r in few_by_hash(rows.select("vec_id", "row", "x"), ["vec_id", "row"], SAMPLE, size["count"]).collect()])
    sent = Sent(spark, Hashing(sample))
    asked = rows.where(is_query)
    blocks, query_blocks = -(-size["count"] // BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    data = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def matrix(of: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = of.column("x").combine_chunks().flatten().to_numpy()
        return flat.reshape(of.num_rows, size.d), of.column("vec_id").to_numpy(), of.column("row").to_numpy()

    def search(key: tuple, both: pa.Table) -> pa.Table:
        out = []
        (q, q_ids, q_rows), (x, ids, own) = (matrix(both.filter(pc.equal(both.column("asks"), asks))) for asks in (True, False))
        if len(q) and len(x):
            out = [(np.full(len(found), q_rows[i]), np.full(len(found), q_ids[i]), ids[found], far) for i, found, far in Forest(sent.value, x, ids, own).search(q, q_rows, k)]
        columns = [np.concatenate(c) if out else np.empty(0) for c in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    both = asked.withColumn("asks", F.lit(True)).unionByName(data.withColumn("asks", F.lit(False)))
    found = both.groupBy("block", "part").applyInArrow(search, schema)
    place = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
