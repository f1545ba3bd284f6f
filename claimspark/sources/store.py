"""Claims, the log and the outbox as Parquet tables in one folder.

A commit is a folder of operations; it exists once a manifest names it. A manifest is written aside,
whole, and takes its name in one step that fails if another has it, so readers and crashes never
see half of one; a writer that finds another commit than it started from must decide again, so
there is one order of commits without locks. A manifest names its own commit; every ``WHOLE``-th one
names all before it too, so that a commit costs the same however many there are.

The one step is a hard link on a local disk and a rename without overwriting elsewhere, which HDFS
does atomically; object stores without such a rename aren't supported for more than one writer.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..kinds import DECIMAL, TYPES
from ..lang import ir
from ..operators import history
from ..plans.compiler import Compiler
from ..plans.derived import derived


WHOLE = 100


class Conflict(RuntimeError):
    """Another writer committed in between."""


def schema_of(p: ir.Predicate) -> T.StructType:
    out = T.StructType()
    for f in p.fields:
        out.add(f.name, DECIMAL if f.kind == "Decimal" else TYPES[f.kind], True, {"kind": f.kind, **({"unit": f.unit} if f.unit else {})})
    return out


class Store:
    def __init__(self, spark: SparkSession, path: str, programme: ir.Programme):
        self.spark, self.path, self.programme = spark, path.rstrip("/"), programme
        jvm = spark.sparkContext._jvm
        self.hadoop = jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- the manifest

    def head(self) -> dict:
        """The commits so far: {"version": n, "order": last position, "commits": [...]}."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self.hadoop(self.path))] if self.fs.exists(self.hadoop(self.path)) else []
        last = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
        if not last:
            return {"version": 0, "order": 0, "commits": []}
        first = max(1, last // WHOLE * WHOLE)
        rows = self.spark.read.text([f"{self.path}/manifest-{v}.json" for v in range(first, last + 1)]).collect()
        told = sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])
        return {"version": last, "order": told[-1]["order"], "commits": [c for m in told for c in m["commits"]]}

    def write_aside(self, text: str) -> str:
        """A file of this text under a name that nothing reads."""
        name = f"{self.path}/.new-{uuid.uuid4().hex}"
        out = self.fs.create(self.hadoop(name), False)
        out.write(bytearray(text.encode()))
        out.close()
        return name

    def publish(self, head: dict) -> None:
        """Name a commit: the last of ``head``'s. Of two writers of one version the later fails."""
        version = head["version"]
        told = {**head, "commits": head["commits"] if version % WHOLE == 0 else head["commits"][-1:]}
        self.named(json.dumps(told), f"{self.path}/manifest-{version}.json")

    def named(self, text: str, name: str) -> None:
        """A whole file under a name that nothing had before."""
        aside, target = self.hadoop(self.write_aside(text)), self.hadoop(name)
        try:
            if self.fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                files.rename(aside, target, never)
        except Exception as e:
            if not self.fs.exists(target):
                raise
            raise Conflict(f"{target.getName()} is taken") from e
        finally:
            self.fs.delete(aside, False)

    # --- reading

    def log(self, predicate: str, upto: int | None = None) -> DataFrame:
        """All operations of a predicate, with ``ord``, ``op``, ``committed_at`` and ``transition``; commits beyond a position aren't opened."""
        columns = schema_of(self.programme.predicates[predicate])
        parts = [f"{self.path}/{c['id']}/{predicate}" for c in self.head()["commits"] if predicate in c["predicates"] and (upto is None or c["order"] <= upto)]
        schema = T.StructType([T.StructField("ord", T.LongType()), T.StructField("op", T.StringType()), T.StructField("committed_at", T.TimestampType()), T.StructField("transition", T.StringType()), *columns.fields])
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def claims(self, predicate: str, order: int | None = None, where: dict | None = None) -> DataFrame:
        """Current claims, or those at a position; ``where`` compares fields for equality."""
        p = self.programme.predicates[predicate]
        log = self.log(predicate, order)
        for name, value in (where or {}).items():
            if name not in p.names():
                raise KeyError(f"{predicate} has no field {name}")
            log = log.where(F.col(name) == F.lit(value))
        return history.as_of(log, p.names(), order)

    def state(self, order: int | None = None) -> dict[str, DataFrame]:
        return {p: self.claims(p, order) for p in self.programme.predicates if p not in self.programme.derived}

    # --- writing

    def commit(self, delta: dict[str, DataFrame], at: str, based_on: int) -> dict:
        """Write an effective delta (claims with op) as one transition, if nothing came between."""
        head = self.head()
        if head["version"] != based_on:
            raise Conflict(f"version {head['version']} follows what was read ({based_on})")
        name, order = uuid.uuid4().hex, head["order"] + 1
        for predicate, d in delta.items():
            columns = self.programme.predicates[predicate].names()
            d.select(F.lit(order).cast("long").alias("ord"), "op", F.to_timestamp(F.lit(at)).alias("committed_at"), F.lit(name).alias("transition"), *(F.col(c).cast(f.dataType).alias(c) for c, f in zip(columns, schema_of(self.programme.predicates[predicate]).fields, strict=True))).write.parquet(f"{self.path}/{name}/{predicate}")
        new = {"version": head["version"] + 1, "order": order, "commits": [*head["commits"], {"id": name, "order": order, "at": at, "predicates": sorted(delta)}]}
        self.publish(new)
        return new

    def views(self) -> None:
        """A temporary view of each predicate's current claims, for SQL."""
        for name, df in self.state().items():
            df.createOrReplaceTempView(name)

    def generation(self, name: str) -> dict | None:
        """The newest generation of a derived claim's cache: {"generation": n, "order": position, "path": folder}."""
        folder = self.hadoop(f"{self.path}/derived/{name}")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        last = max((int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json")), default=0)
        return json.loads(self.spark.read.text(f"{self.path}/derived/{name}/current-{last}.json").first().value) if last else None

    def refresh(self, name: str) -> dict:
        """Compute a derived claim from the current claims and make the result its newest generation.

        Readers see the generation before until the new one is whole; of two refreshes at once the later fails.
        """
        head, before = self.head(), self.generation(name)
        d = self.programme.derived[name]
        answer = derived(Compiler(self.spark, self.programme, self.state(head["order"])), d)
        number = (before["generation"] if before else 0) + 1
        path = f"{self.path}/derived/{name}/{uuid.uuid4().hex}"
        answer.write.parquet(path)
        told = {"generation": number, "order": head["order"], "path": path}
        self.named(json.dumps(told), f"{self.path}/derived/{name}/current-{number}.json")
        return told

    def cached(self, name: str) -> DataFrame:
        """A derived claim as last refreshed; ``generation`` says at which position."""
        told = self.generation(name)
        if told is None:
            raise KeyError(f"{name} was never refreshed")
        return self.spark.read.parquet(told["path"])

    def catalogue(self) -> DataFrame:
        """Predicates, fields, kinds and disciplines."""
        rows = [(p.name, i, f.name, f.kind, f.unit, p.append_only) for p in self.programme.predicates.values() for i, f in enumerate(p.fields)]
        return self.spark.createDataFrame(rows, "predicate string, position int, field string, kind string, unit string, append_only boolean")

    def keyed(self, predicate: str) -> DataFrame:
        """Claims with their identity."""
        p = self.programme.predicates[predicate]
        return self.claims(predicate).withColumn("claim_key", scalar.claim_key([f.kind for f in p.fields], [F.col(n) for n in p.names()]))


def page(log: DataFrame, after: int, size: int) -> DataFrame:
    """The next rows of a log after a position."""
    return log.where(F.col("ord") > after).orderBy("ord").limit(size)


def newest(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    return rows.orderBy(*(F.col(b).desc() for b in by)).limit(k)


def mentions(rows: DataFrame, subjects: str, subject: str) -> DataFrame:
    """Rows whose array of subjects holds one."""
    return rows.where(F.array_contains(subjects, subject))
