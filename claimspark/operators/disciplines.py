"""What a predicate's declaration promises, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicated(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Keys under which different claims stand, by one shuffle: no self-join."""
    rest = [c for c in claims.columns if c not in keys]
    low, high = (f(F.struct(*rest)) for f in (F.min, F.max))
    return claims.groupBy(*keys).agg(low.alias("low"), high.alias("high")).where("low <> high").select(*keys)


def forks(links: DataFrame) -> DataFrame:
    """What several successors replace: links are (successor, prior)."""
    successor, prior = links.columns[:2]
    return links.groupBy(prior).agg(F.countDistinct(successor).alias("successors")).where("successors > 1")


def retracted_against(claims: DataFrame, deleted: DataFrame) -> DataFrame:
    """Claims of an append-only predicate that a change would take away."""
    return deleted.join(claims, list(claims.columns), "left_semi")


def versions_in_force(asked: DataFrame, versions: DataFrame, keys: list[str], at: str, on: str) -> DataFrame:
    """Each asked row with the version in force on its date ``at``: the latest one not after it.

    Versions and questions meet in one shuffle by key; a window carries the last version on, so
    cost doesn't grow with the number of versions of a key times its questions.
    """
    from pyspark.sql import Window as W

    payload = [c for c in versions.columns if c not in keys and c != on]
    v = versions.select(*keys, F.col(on).alias("__at"), F.lit(0).alias("__side"), F.struct(on, *payload).alias("__version"), F.lit(None).cast(asked.select(F.struct("*").alias("a")).schema["a"].dataType).alias("__row"))
    a = asked.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(v.schema["__version"].dataType).alias("__version"), F.struct(*asked.columns).alias("__row"))
    carried = F.last("__version", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0))
    both = v.unionByName(a).withColumn("__version", carried).where("__side = 1 AND __version IS NOT NULL")
    return both.select("__row.*", *(F.col(f"__version.{c}").alias(c) for c in [on, *payload]))


def missing_versions(asked: DataFrame, versions: DataFrame, keys: list[str], at: str, on: str) -> DataFrame:
    """Questions that no version answers: breaches of totality."""
    first = versions.groupBy(*keys).agg(F.min(on).alias("__first"))
    joined = asked.join(first, keys, "left")
    return joined.where(F.col("__first").isNull() | (F.col("__first") > F.col(at))).drop("__first")


def restricted(proposals: DataFrame, authority: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals whose actor no claim of authority covers."""
    return proposals.join(authority, keys, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
