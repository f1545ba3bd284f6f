"""Calendar rows: business days and the bounds of local days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))


def business_days(spark: SparkSession, first: str, last: str, holidays: DataFrame) -> DataFrame:
    """Mondays to Fridays that aren't in ``holidays`` (one column, day), numbered."""
    from pyspark.sql import Window as W

    open_ = days(spark, first, last).where("dayofweek(day) BETWEEN 2 AND 6").join(holidays, "day", "left_anti")
    return open_.withColumn("number", F.row_number().over(W.partitionBy(F.year("day")).orderBy("day")))


def local_days(spark: SparkSession, first: str, last: str, zone: str) -> DataFrame:
    """Each local day's bounds as instants, and its length: 23 or 25 hours where clocks change."""
    start, end = F.to_utc_timestamp(F.col("day").cast("timestamp"), zone), F.to_utc_timestamp(F.date_add("day", 1).cast("timestamp"), zone)
    return days(spark, first, last).select("day", start.alias("starts_at"), end.alias("ends_at"), ((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).cast("int").alias("hours"))
