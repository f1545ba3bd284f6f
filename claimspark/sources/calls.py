"""Proposals as JSON lines, and receipts for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kinds import DECIMAL, TYPES
from ..operators.act import PID, Outcome


def read_calls(spark: SparkSession, path: str, name: str, kinds: dict[str, str]) -> DataFrame:
    """Calls of one transformation: lines ``{"id", "transformation", "actor", "decided_at", "arguments"}``.

    Decimals are strings on the wire, so that none is rounded. An argument that isn't of its kind
    makes the line malformed; malformed lines have a null pid.
    """
    fields = [T.StructField(n, T.ArrayType(T.StringType()) if k == "Collection" else T.StringType()) for n, k in kinds.items()]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("transformation", T.StringType()), T.StructField("actor", T.StringType()), T.StructField("decided_at", T.StringType()), T.StructField("arguments", T.StructType(fields))])
    lines = spark.read.schema(schema).json(path).where(F.col("transformation") == name)
    typed = {n: F.col(f"arguments.{n}") if k in ("Subject", "Collection", "Any") else F.col(f"arguments.{n}").try_cast(DECIMAL if k == "Decimal" else TYPES[k]) for n, k in kinds.items()}
    whole = F.lit(True)
    for column in typed.values():
        whole = whole & column.isNotNull()
    return lines.select(F.when(whole, F.col("id")).alias(PID), "actor", F.to_timestamp("decided_at").alias("decided_at"), *(c.alias(n) for n, c in typed.items()))


def receipts(proposals: DataFrame, outcome: Outcome) -> DataFrame:
    """A row for each proposal: accepted, or by what it was refused."""
    return proposals.select(PID).join(outcome.refused.hint("merge"), PID, "left").select(PID, F.col("kind").isNull().alias("accepted"), "kind", "rule")


def misfits(stored: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Stored rows with a value that isn't of its declared type, and the first such field."""
    bad = [F.when(F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), F.lit(n)) for n, t in columns.items()]
    return stored.withColumn("misfit", F.coalesce(*bad)).where("misfit IS NOT NULL")
