"""Least fixpoints by semi-naive evaluation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and everything runs on one machine, as in tests, a temporary folder
    takes its place for the application.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        name = spark.sparkContext.applicationId
        if name not in OWN_FOLDERS:
            OWN_FOLDERS[name] = tempfile.mkdtemp(prefix="claimspark-")
            atexit.register(shutil.rmtree, OWN_FOLDERS[name], ignore_errors=True)
        where = OWN_FOLDERS[name]
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The smallest set that holds ``seed`` and what ``step`` makes of its members.

    ``step`` gets only what the last round found new, so each answer is extended once; it ends, on
    cycles too, when a round finds nothing new.
    """
    fresh = written(seed.distinct(), "fixpoint")
    found = [fresh]
    while not fresh.isEmpty():
        known = found[0]
        for more in found[1:]:
            known = known.union(more)
        fresh = written(step(fresh).distinct().join(known, seed.columns, "left_anti").select(*seed.columns), "fixpoint")
        found.append(fresh)
        if len(found) == 8:  # few tables are read again in each round
            found = [written(known.union(fresh), "fixpoint")]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
