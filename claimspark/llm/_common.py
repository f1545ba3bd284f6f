"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every contract here means it: blank and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
OWN_FOLDERS: dict[str, str] = {}
#: The folders written so far by the work that ``settled`` is doing, if it is doing any.
BETWEEN: ContextVar[list[str] | None] = ContextVar("between", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and all runs
    on one machine, as in tests, a temporary folder takes its place for the application.
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


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Send texts to Python in batches of a few MB, whatever the number of rows: workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage so that a lost executor costs only the tasks that ran on it, and fixes
    values (row numbers, say) that a recomputation might deal differently.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (folders := BETWEEN.get()) is not None:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns, written by ``materialise``; the tables written on the way are deleted."""
    token = BETWEEN.set(folders := [])
    out = None
    try:
        out = materialise(make(), tag)
    finally:
        BETWEEN.reset(token)
        for path in folders if out is None else folders[:-1]:
            remove(spark, path)
    return out


def bucketed(df: DataFrame, column: str, count: int, tag: str) -> DataFrame:
    """Like ``materialise``, in ``count`` buckets by ``column``: grouping by it needs no shuffle."""
    spark = df.sparkSession
    bounded_batches(spark)
    name = f"{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(count, column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files stay, and so does what reads them
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table that ``materialise`` wrote and nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, parent)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Sent:
    """An object of bounded size that all executors get once; ``value`` is the object.

    It travels with its class, so executors need not have this package installed.
    """

    def __init__(self, spark: SparkSession, value: object):
        self.data, self.loaded = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"data": self.data, "loaded": None}

    @property
    def value(self):
        if self.loaded is None:
            self.loaded = (cloudpickle.loads(self.data.value),)
        return self.loaded[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of an Arrow string column as UTF-8; a null is an empty text."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        binary = chunk.cast(pa.large_binary() if pa.types.is_large_string(chunk.type) else pa.binary())
        for value in binary:
            yield value.as_py() or b""


def texts(column: pa.Array) -> list[str]:
    """The texts of an Arrow string column; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def per_row(
    df: DataFrame, schema: str, names: list[str], row: Callable[..., list], prepare: Callable[[], object] | None = None
) -> DataFrame:
    """Map the rows of ``df`` to columns ``names`` of ``schema``, one Arrow batch at a time.

    ``row`` gets the values of a row and, if ``prepare`` is given, what that returned once in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = [prepare()] if prepare else []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = [row(*values, *extra) for values in zip(*columns, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names
                )

    types = arrow_types(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_types(spark: SparkSession, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)).types)


def few_by_hash(df: DataFrame, columns: list[str], k: int, rows: int) -> DataFrame:
    """The ``k`` rows with the smallest hash of ``columns``, out of ``rows``: a fixed sample.

    A first cut by the hash leaves about twice as many, so that tasks send little to the driver
    however many they are.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << 30))
    likely = min(1 << 30, int((2 * k + 50) / max(1, rows) * (1 << 30)))
    return df.withColumn("_place", place).where(F.col("_place") < likely).orderBy("_place", *columns).limit(k).drop("_place")


def training_row(doc_id: str, modulus: int, held: int):
    """(held out?, learned from?) by crc32 of the id as text; a null id is neither."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == held, F.lit(False)), F.coalesce(rest != held, F.lit(False))
