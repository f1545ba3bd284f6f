"""The outbox: effects with a status, delivered at least once under leases.

States: pending, in_progress, delivered, failed, compensation_done and compensation_failed. All steps are set
operations on a frame of rows: intent_id, intent, idempotency_key, status, attempts, enqueued_at,
next_attempt_at, lease_until.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def idempotent(rows: DataFrame) -> DataFrame:
    """The first row of each idempotency key."""
    first = F.row_number().over(W.partitionBy("idempotency_key").orderBy("enqueued_at", "intent_id"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n")


def due(rows: DataFrame, now: Column) -> DataFrame:
    """Pending rows whose time has come, and rows whose lease ran out."""
    waiting = (F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    lost = (F.col("status") == "in_progress") & (F.col("lease_until") < now)
    return rows.where(waiting | lost)


def claim_next(rows: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The oldest due rows, first in first out."""
    return due(rows, now).orderBy("enqueued_at", "intent_id").limit(k)


def take(rows: DataFrame, now: Column, k: int = 1, lease_seconds: int = 60) -> DataFrame:
    """All rows after a worker has taken the ``k`` oldest due ones: those are in progress until their lease ends."""
    mine = claim_next(rows, now, k).select("intent_id", F.lit(True).alias("__mine"))
    out = rows.join(F.broadcast(mine) if k <= 10_000 else mine, "intent_id", "left")
    until = F.timestamp_seconds(F.unix_seconds(now) + lease_seconds)
    taken = F.col("__mine").isNotNull()
    return out.withColumns({"status": F.when(taken, F.lit("in_progress")).otherwise(F.col("status")), "lease_until": F.when(taken, until).otherwise(F.col("lease_until"))}).select(*rows.columns)


def compensated(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows after acts that make up for failed effects: ``results`` has intent_id and ok.

    A failed row becomes ``compensation_done`` or ``compensation_failed``; rows in other states,
    and those without a result, stay as they are, so a result that comes twice changes nothing more.
    """
    r = rows.join(results.groupBy("intent_id").agg(F.min("ok").alias("__ok")), "intent_id", "left")
    after = F.when(F.col("__ok"), "compensation_done").otherwise("compensation_failed")
    return r.withColumn("status", F.when((F.col("status") == "failed") & F.col("__ok").isNotNull(), after).otherwise(F.col("status"))).select(*rows.columns)


def settle(rows: DataFrame, results: DataFrame, now: Column, most: int, base_seconds: int = 2) -> DataFrame:
    """Rows after attempts: ``results`` has intent_id and ok (null: to be tried again).

    A retry waits twice as long each time, spread by up to a quarter by a hash of the id; after
    ``most`` attempts, or a plain refusal, the row has failed and its compensation is due.
    """
    r = rows.join(results.withColumnRenamed("ok", "__ok").withColumn("__tried", F.lit(True)), "intent_id", "left")
    tried = F.coalesce("__tried", F.lit(False))
    attempts = F.col("attempts") + tried.cast("int")
    jitter = 1 + (F.pmod(F.xxhash64("intent_id"), F.lit(51)) - 25) / 100
    wait = F.pow(F.lit(2), F.col("attempts")) * base_seconds * jitter
    status = F.when(~tried, F.col("status")).when(F.col("__ok"), "delivered").when((~F.col("__ok")) | (attempts >= most), "failed").otherwise("pending")
    later = F.when(tried & (status == "pending"), F.timestamp_seconds(F.unix_seconds(now) + wait)).otherwise(F.col("next_attempt_at"))
    return r.select("intent_id", "intent", "idempotency_key", status.alias("status"), attempts.alias("attempts"), "enqueued_at", later.alias("next_attempt_at"), "lease_until")


def compensations(rows: DataFrame) -> DataFrame:
    """What failed for good and wants an act that makes up for it."""
    return rows.where("status = 'failed'").select("intent_id", "intent", F.concat("idempotency_key", F.lit("/compensation")).alias("idempotency_key"))


def next_wake(rows: DataFrame) -> DataFrame:
    """When the earliest retry is due."""
    return rows.where("status = 'pending'").agg(F.min("next_attempt_at").alias("wake_at"))
