"""Tables that change together, in versions.

Every table is an ordinary Spark table, PARTITIONED BY (__version) and CLUSTERED BY (__bucket), where __bucket is a hash of
the root key, so all rows of a document lie in one bucket of each table. A commit writes only the buckets that it
touches, under a version of its own, and at last adds one small file to the schema's log: which buckets of which
versions are live, for all tables. Readers take the newest log entry, so they see all of a commit or nothing of it,
whatever step fails; what a failed commit has written is live nowhere and goes with ``vacuum``.

Old rows of touched buckets are read with bucket pruning and stay where their buckets put them: neither their
anti-join with the keys that go nor their writing shuffles them. One writer at a time: a log number that is taken already
is an error, and the commit that lost can be run again.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

VERSION, BUCKET = "__version", "__bucket"


class CommitConflict(RuntimeError):
    """Another commit came first."""


class Log:
    """Numbered JSON files in a folder, each written under another name and renamed. The highest one holds."""

    def __init__(self, spark: SparkSession, folder: str):
        context = spark.sparkContext
        self.jvm, self.folder = context._jvm, folder
        self.fs = self._path(folder).getFileSystem(context._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{number:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def add(self, number: int, state: dict) -> None:
        name, fresh = self._path(f"{self.folder}/{number:020d}.json"), self._path(f"{self.folder}/.{random.getrandbits(64):016x}")
        self.fs.mkdirs(self._path(self.folder))
        stream = self.fs.create(fresh, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self.fs.exists(name) or not self.fs.rename(fresh, name):
            self.fs.delete(fresh, False)
            raise CommitConflict(f"commit {number} exists already")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def measured(seen: Observation) -> dict:
    """What a job has observed; nothing where the optimizer found that it has no rows."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key.cast("string")), F.lit(buckets))


class Store:
    """The versioned tables of one schema. buckets: of tables that are created from now on, in proportion to their size
    (a bucket is rewritten as a whole and is one task)."""

    def __init__(self, spark: SparkSession, schema: str, buckets: int = 16):
        self.spark, self.schema, self.buckets = spark, schema, buckets

    def name(self, table: str) -> str:
        return f"`{self.schema}`.`{table}`"

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.spark.catalog.getDatabase(self.schema).locationUri.rstrip('/')}/_commits")

    def layout(self) -> str:
        """What follows the columns in CREATE TABLE."""
        return f"PARTITIONED BY (`{VERSION}`) CLUSTERED BY (`{BUCKET}`) INTO {self.buckets} BUCKETS"

    def create(self, table: str, columns: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}, `{BUCKET}` INT, `{VERSION}` BIGINT) USING parquet {self.layout()}")

    def columns(self, table: str) -> list[str]:
        return [c for c in self.spark.table(self.name(table)).columns if c not in (VERSION, BUCKET)]

    def buckets_of(self, table: str) -> int:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table)}").where("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])

    def live(self, table: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """The live rows, of some buckets or all, with their bucket."""
        df = self.spark.table(self.name(table))
        if VERSION not in df.columns:
            return df
        pairs = [(int(v), b) for v, held in state.get(table, {}).items() for b in held if buckets is None or b in set(buckets)]
        df = df.where(F.col(VERSION).isin(sorted({v for v, _ in pairs})) & (F.lit(True) if buckets is None else F.col(BUCKET).isin(buckets)))
        if not pairs:
            return df.where(F.lit(False)).drop(VERSION)
        # At most a row per bucket and version.
        held = self.spark.createDataFrame(pairs, f"{VERSION} long, {BUCKET} int")
        return df.join(F.broadcast(held), [VERSION, BUCKET], "left_semi").drop(VERSION)

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as the newest commit left it, or an earlier one."""
        log = self.log
        return self.live(table, log.read(number) if number else log.latest()[1]).drop(BUCKET)

    def commit(self, progress: Callable[[str, str], None] | None = None) -> Commit:
        return Commit(self, progress)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Drops versions that none of the last ``keep`` commits has; they are returned. Not while a commit runs."""
        log, gone = self.log, []
        held = {int(v) for n in log.numbers()[-keep:] for live in log.read(n).values() for v in live}
        for t in self.spark.catalog.listTables(self.schema):
            if t.isTemporary or VERSION not in self.spark.table(self.name(t.name)).columns:
                continue
            for r in self.spark.sql(f"SHOW PARTITIONS {self.name(t.name)}").collect():
                version = int(r["partition"].partition("=")[2])
                if version not in held:
                    self.spark.sql(f"ALTER TABLE {self.name(t.name)} DROP IF EXISTS PARTITION ({VERSION} = {version})")
                    gone.append(version)
        return gone


class Commit:
    """Changes that readers see together, after ``finish``. progress: called before each step with its name and
    table; what it raises ends the commit."""

    def __init__(self, store: Store, progress: Callable[[str, str], None] | None = None):
        self.store, self.progress = store, progress or (lambda step, table: None)
        self.number, self.state = store.log.latest()
        self.version = (self.number + 1) << 24 | random.getrandbits(24)
        self.rewritten: dict[str, list[int]] = {}

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """Buckets of keys (one column): at most as many as the table has."""
        of = bucket_of(F.col(keys.columns[0]), self.store.buckets_of(table))
        return sorted(r[0] for r in keys.select(of).distinct().collect())

    def replace(self, table: str, column: str, keys: DataFrame, rows: DataFrame | None = None, touched: list[int] | None = None, metrics: list[Column] = ()) -> dict:
        """Rows of ``keys`` (one column, each key at most once) go, ``rows`` come; metrics of those are returned."""
        buckets = self.store.buckets_of(table)
        touched = self.touched(table, keys) if touched is None else touched
        gone = keys.select(F.col(keys.columns[0]).alias(column)).select(bucket_of(F.col(column), buckets).alias(BUCKET), column)
        self.progress("keep", table)
        if self.state.get(table):
            old = self.store.live(table, self.state, touched).join(gone.repartition(buckets, BUCKET), [BUCKET, column], "left_anti")
            # Both sides lie by bucket; the key needs no exchange of its own.
            with setting(self.store.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
                self._write(table, old)
        found = {}
        if rows is not None:
            found = self._add(table, column, rows, metrics)
        held = {v: [b for b in live if b not in set(touched)] for v, live in self.state.get(table, {}).items()}
        self._record(table, {v: live for v, live in held.items() if live}, touched)
        return found

    def append(self, table: str, column: str, rows: DataFrame, metrics: list[Column] = ()) -> dict:
        """Rows more, whatever is there; ``column`` gives their buckets. Metrics of the rows are returned."""
        found = self._add(table, column, rows, metrics)
        self._record(table, self.state.get(table, {}), list(range(self.store.buckets_of(table))))
        return found

    def clear(self, table: str) -> None:
        self.progress("clear", table)
        self.state = {**self.state, table: {}}

    def _add(self, table: str, column: str, rows: DataFrame, metrics: list[Column]) -> dict:
        self.progress("add", table)
        buckets = self.store.buckets_of(table)
        seen = Observation()
        rows = rows.observe(seen, *metrics) if metrics else rows
        rows = rows.withColumn(BUCKET, bucket_of(F.col(column), buckets)).repartition(buckets, BUCKET)
        self._write(table, rows)
        return measured(seen) if metrics else {}

    def _record(self, table: str, held: dict, touched: list[int]) -> None:
        self.rewritten[table] = sorted({*self.rewritten.get(table, ()), *touched})
        own = sorted({*held.get(str(self.version), ()), *touched})
        self.state = {**self.state, table: {**held, str(self.version): own} if own else held}

    def _write(self, table: str, rows: DataFrame) -> None:
        fields = self.store.spark.table(self.store.name(table)).schema.fields
        typed = [F.lit(self.version).alias(VERSION) if f.name == VERSION else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]
        rows.select(*typed).write.insertInto(self.store.name(table))

    def finish(self) -> int:
        self.progress("commit", "")
        self.store.log.add(self.number + 1, self.state)
        return self.number + 1
