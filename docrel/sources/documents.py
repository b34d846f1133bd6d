"""Documents as (seq, v): a number that follows reading order and a VARIANT value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import fragments, read_array_texts


def from_table(df: DataFrame, key: str | None = None, nulls: bool = False) -> DataFrame:
    """Typed rows as documents; null fields are missing fields unless ``nulls``. seq follows the key where one is given."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    v = F.to_variant_object(whole) if nulls else F.parse_json(F.to_json(whole))
    seq = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    return df.select(seq.alias("seq"), v.alias("v"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line, v): lines that are not blank, with v null where a line is not JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"), F.try_parse_json("value").alias("v"))


def read_json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One document per line; blank lines are skipped. A line that is not JSON is an error, or left out if not strict
    (``bad_lines`` counts those)."""
    lines = json_lines(spark, path)
    if not strict:
        return lines.where("v is not null").select("seq", "v")
    # Spark may look at a value before it drops blank lines.
    broken = F.col("v").isNull() & (F.trim("line") != "")
    failed = F.raise_error(F.concat(F.lit("not JSON: "), F.left("line", F.lit(80)))).cast("variant")
    return lines.select("seq", F.when(broken, failed).otherwise(F.col("v")).alias("v"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path).where("v is null").agg(F.count("*").alias("n"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file, read in the order of the files' names, large files by many tasks. A file that is not one
    JSON array is an error."""
    items = read_array_texts(spark, path)
    return items.select((F.col("file") * (1 << 32) + F.col("number")).alias("seq"), F.parse_json("text").alias("v"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Chooses by the first character that is not blank: [ starts an array, all else is lines."""
    first = fragments(spark, path).where(F.trim("value") != "").limit(1).collect()
    return read_json_array(spark, path) if first and first[0]["value"].lstrip("\ufeff \t\r\n").startswith("[") else read_json_lines(spark, path)


def sample(df: DataFrame, size: int, key: str, seed: int = 0, order=None) -> DataFrame:
    """``size`` rows in a seeded order of the key (or the given order), the same on every run; 0 means all."""
    order = F.xxhash64(F.lit(seed), key) if order is None else order
    return df.orderBy(order, key).limit(size) if size else df


def after(df: DataFrame, key: str, last) -> DataFrame:
    """Rows beyond a watermark; all rows without one."""
    return df if last is None else df.where(F.col(key) > F.lit(last))


def count(df: DataFrame, predicate: str | None = None) -> DataFrame:
    return (df.where(predicate) if predicate else df).agg(F.count("*").alias("n"))


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.name.startswith("system."))


def list_databases(spark: SparkSession, hidden: tuple[str, ...] = ("admin", "config", "local")) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name not in hidden)
