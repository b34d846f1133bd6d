"""Loading flattened tables into a catalog: create, upsert by root key, widths, watermark.

A load replaces all rows of the keys it brings (old rows are anti-joined away, child rows included), so loading twice
is loading once. All tables of a plan and the watermark change in one commit (see ``versions``): a load that fails at any
step leaves every table as it was. Documents are read once, into a folder beside the tables that is deleted at the end; then
each table is one job, and what the load reports is measured by the jobs that write.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.variants import width_of
from ..plans.nesting import ROOT_KEY, Plan, bind
from ..plans.render import shape_of, spark_columns
from .flatten import flatten, with_key
from .versions import Commit, Store, measured

STATE, REJECTS = "load_state", "load_rejects"


@dataclass
class LoadStats:
    documents: int = 0
    without_key: int = 0
    clipped: int = 0
    rows: dict[str, int] = field(default_factory=dict)
    last_id: str | None = None
    last_id_type: str | None = None
    mode: str = "full"
    rejected: int = 0
    commit: int | None = None
    rewritten: dict[str, list[int]] = field(default_factory=dict)

    @property
    def total_rows(self) -> int:
        return sum(self.rows.values())


class Catalog(Store):
    """Tables of one schema in the Spark catalog, read and changed by versions. Tables of the schema that were made
    otherwise can be read."""

    def ensure_schema(self) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{self.schema}`")

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.schema}.{table}")

    def drop(self, *tables: str) -> None:
        """Their rows are gone with the commit, then the tables."""
        there = [t for t in tables if self.exists(t)]
        commit = self.commit()
        if any(t in commit.state for t in there):
            commit.state = {t: live for t, live in commit.state.items() if t not in there}
            commit.finish()
        for t in there:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(t)}")

    def clear(self, table: str) -> None:
        commit = self.commit()
        commit.clear(table)
        commit.finish()

    def append(self, table: str, rows: DataFrame, column: str | None = None) -> None:
        """Adds rows; column: the root key's, the first one by default."""
        commit, columns = self.commit(), self.columns(table)
        commit.append(table, column or columns[0], rows.select(*columns))
        commit.finish()

    def script(self, statements: str) -> None:
        """Runs statements that end in ; at a line's end; lines that start with -- are comments."""
        lines = [x for x in statements.splitlines() if not x.lstrip().startswith("--")]
        for statement in "\n".join(lines).split(";\n"):
            if statement.strip(" \n;"):
                self.spark.sql(statement.strip(" \n;"))

    def widths(self, table: str) -> dict[str, int | None]:
        """Declared widths of the text columns of a live table."""
        fields = self.spark.table(self.name(table)).schema.fields
        return {f.name: width_of(f.metadata.get("comment", "")) for f in fields if f.metadata.get("comment", "").startswith(("NVARCHAR", "CHAR"))}

    def delete_keys(self, table: str, column: str, keys: DataFrame) -> Commit:
        """Takes the rows of the keys (one column) from a table."""
        return self._delete({table: column}, keys)

    def delete_documents(self, plan: Plan, keys: DataFrame) -> Commit:
        """Takes all rows of the keys from all tables of a plan, in one commit."""
        return self._delete(key_columns(plan), keys)

    def _delete(self, column_of: dict[str, str], keys: DataFrame) -> Commit:
        commit, keys = self.commit(), keys.where(F.col(keys.columns[0]).isNotNull()).distinct()
        for table, column in column_of.items():
            commit.replace(table, column, keys)
        commit.finish()
        return commit


def without_keys(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows whose key is not among ``keys`` (one column)."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_anti")


def upserted(old: DataFrame, new: DataFrame, column: str, keys: DataFrame | None = None) -> DataFrame:
    """old with the rows of the new keys replaced by ``new``."""
    keys = keys if keys is not None else new.select(column)
    return without_keys(old, column, keys).select(*new.columns).unionByName(new)


def key_columns(plan: Plan) -> dict[str, str]:
    """Tables in the order of loading, children first, with their columns of the root key."""
    return {t.name: ROOT_KEY if t.kind == "root" else t.parent_key for t in reversed(plan.tables)}


def ensure_tables(catalog: Catalog, plan: Plan, recreate: bool = False) -> tuple[list[str], list[str]]:
    """Creates what is missing. Names created, and names that were there."""
    catalog.ensure_schema()
    if recreate:
        catalog.drop(*key_columns(plan))
    there = [t.name for t in plan.tables if catalog.exists(t.name)]
    for table in plan.tables:
        catalog.create(table.name, spark_columns(plan, table))
    return [t.name for t in plan.tables if t.name not in there], there


def staged(docs: DataFrame, plan: Plan, folder: str) -> tuple[DataFrame, dict]:
    """Of documents with one key the last in reading order (seq, v, __key), written to ``folder`` in one job that also
    counts documents, and those without a key."""
    seen = Observation()
    known = with_key(docs.select("seq", "v"), plan)
    known = known.observe(seen, F.count("*").alias("documents"), F.count_if(F.col("__key").isNull()).alias("without_key"))
    last = known.where("__key is not null").groupBy("__key").agg(F.max_by(F.struct("seq", "v"), "seq").alias("d"))
    last = last.select("d.seq", "d.v", "__key")
    last.write.parquet(folder)
    return docs.sparkSession.read.schema(last.schema).parquet(folder), measured(seen)


def bound(plan: Plan, catalog: Catalog) -> Plan:
    """The plan with its texts no wider than the live tables' columns."""
    return bind(plan, {t.name: catalog.widths(t.name) for t in plan.tables if catalog.exists(t.name)})


def misfits(flat: dict[str, DataFrame], plan: Plan) -> DataFrame:
    """(__key, reason): documents with a null, in any of their rows, where the plan allows none."""
    found = None
    for table in plan.tables:
        key = ROOT_KEY if table.kind == "root" else table.parent_key
        must = [c.name for c in table.columns if not c.nullable and c.name != ROOT_KEY]
        if must:
            why = F.coalesce(*[F.when(F.col(f"`{c}`").isNull(), F.lit(f"{table.name}.{c} is null")) for c in must])
            # Not a filter, which would be pushed down with all that the columns are computed from.
            rows = flat[table.name].select(F.col(key).alias("__key"), F.explode(F.filter(F.array(why), lambda w: w.isNotNull())).alias("reason"))
            found = rows if found is None else found.unionAll(rows)
    if found is None:
        return flat[plan.root.name].select(F.col(ROOT_KEY).alias("__key"), F.lit("").alias("reason")).where(F.lit(False))
    return found.groupBy("__key").agg(F.min("reason").alias("reason"))


def load(
    docs: DataFrame,
    plan: Plan,
    catalog: Catalog,
    clear_first: bool = False,
    mode: str = "full",
    watermark: bool = False,
    progress: Callable[[int, int, str], None] | None = None,
    quarantine: bool = False,
) -> LoadStats:
    """Flattens documents (seq, v) and upserts every table of the plan, in one commit with the watermark if that is
    asked for. progress: gets the steps done, all steps and the name of the next one. quarantine: documents without a key,
    or with a null where the plan allows none, go to the table of rejects with the reason (what the tables have of their
    keys stays), and the rest is loaded."""
    spark, stats, plan = catalog.spark, LoadStats(mode=mode), bound(plan, catalog)
    tables = key_columns(plan)
    steps = 2 + (2 + clear_first) * len(tables) + 2 * watermark + 2 * quarantine
    done = iter(range(steps))

    def step(name: str, table: str = "") -> None:
        if progress:
            progress(next(done), steps, f"{name} {table}".strip())

    if watermark:
        ensure_state(catalog)
    if quarantine:
        catalog.ensure_schema()
        catalog.create(REJECTS, "collection STRING, key STRING, reason STRING, document STRING")
    commit = catalog.commit(step)
    folder = f"{catalog.log.folder}/_staged-{uuid.uuid4().hex}"
    try:
        step("read")
        documents, counts = staged(docs, plan, f"{folder}/documents")
        stats.documents, stats.without_key = counts.get("documents", 0), counts.get("without_key", 0)
        flat = flatten(documents.select("seq", "v"), plan)
        if quarantine:
            step("judge")
            misfits(flat, plan).write.parquet(f"{folder}/rejected")
            bad = spark.read.schema(misfits(flat, plan).schema).parquet(f"{folder}/rejected")
            rejected = documents.join(bad, "__key").unionByName(with_key(docs.select("seq", "v"), plan).where("__key is null").withColumn("reason", F.lit("no key")))
            rejected = rejected.select(F.lit(plan.collection).alias("collection"), F.col("__key").cast("string").alias("key"), "reason", F.to_json("v").alias("document"))
            stats.rejected = commit.append(REJECTS, "key", rejected, [F.count("*").alias("rows")]).get("rows", 0)
            documents = documents.join(bad, "__key", "left_anti")
            flat = flatten(documents.select("seq", "v"), plan)
        keys = documents.select("__key")
        if clear_first:
            for table in tables:
                commit.clear(table)
        touched: dict[int, list[int]] = {}
        for table, column in tables.items():
            buckets = catalog.buckets_of(table)
            touched[buckets] = touched[buckets] if buckets in touched else commit.touched(table, keys)
            names = [n for n, _, _ in shape_of(plan, next(t for t in plan.tables if t.name == table))[0]]
            counted = [F.count("*").alias("rows"), F.coalesce(F.sum("__clipped"), F.lit(0)).alias("clipped"), F.max(column).alias("last")]
            found = commit.replace(table, column, keys, flat[table].select(*names, "__clipped"), touched[buckets], counted)
            stats.rows[table] = found.get("rows", 0)
            stats.clipped += found.get("clipped", 0)
        stats.last_id, stats.last_id_type = encode_key(found.get("last"), plan.key)  # the root goes last
        stats.rewritten = {t: commit.rewritten.get(t, []) for t in tables}
        if watermark and stats.last_id is not None:
            put_watermark(commit, plan.collection, stats)
        stats.commit = commit.finish()
        if progress:
            progress(steps, steps, "done")
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return stats


def encode_key(value, declared: str) -> tuple[str | None, str | None]:
    """A key as text and its kind: objectid, int or str."""
    if value is None:
        return None, None
    kind = "int" if declared in ("INT", "BIGINT") else "objectid" if declared == "CHAR(24)" else "str"
    return str(value), kind


def decode_key(text: str | None, kind: str | None):
    return int(text) if text is not None and kind == "int" else text


def ensure_state(catalog: Catalog) -> None:
    catalog.ensure_schema()
    catalog.create(STATE, "collection STRING, last_id STRING, last_id_type STRING, updated TIMESTAMP")


def put_watermark(commit: Commit, collection: str, stats: LoadStats) -> None:
    row = commit.store.spark.createDataFrame([(collection, stats.last_id, stats.last_id_type)], "collection string, last_id string, last_id_type string")
    commit.replace(STATE, "collection", row.select("collection"), row.withColumn("updated", F.current_timestamp()))


def save_watermark(catalog: Catalog, collection: str, stats: LoadStats) -> None:
    """One row per collection; a load without keys keeps the last one."""
    if stats.last_id is None:
        return
    ensure_state(catalog)
    commit = catalog.commit()
    put_watermark(commit, collection, stats)
    commit.finish()


def load_watermark(catalog: Catalog, collection: str):
    if not catalog.exists(STATE):
        return None
    row = catalog.read(STATE).where(F.col("collection") == collection).select("last_id", "last_id_type").first()
    return decode_key(*row) if row else None
