"""Small helpers that several operators share: words, byte hashes, shared folders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, shared_dir  # noqa: F401

#: What separates words: space and the ASCII controls 0x09 to 0x0D. bytes.split() uses the same six bytes.
WHITE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_for(df: DataFrame, rows: int) -> int:
    """To how many partitions to coalesce what is made from df (a table, so that its count is cheap) before it is written:
    one for each ``rows`` rows of df, no fewer than keep all cores busy. A file of few rows costs far more than they do."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


#: Bytes of a batch that goes to Python; Spark's own limits are 10,000 rows, whatever they hold, and 64 MB.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands texts to Python by BATCH_BYTES, so that a task holds neither 10,000 nor 64 MB of them, in
    the JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Marks the columns that ``numbered`` has made, so that columns of an input with their names are not taken for them.
_NUMBERED = {"numbered": True}


def plain_read(df: DataFrame) -> bool:
    """Is df rows of files, projected or filtered, so that each of them is one row of a file?"""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def numbered(df: DataFrame) -> DataFrame:
    """df with ``__file`` (a hash that tells its files apart) and ``__row`` (the row's number in its file); an input's own
    columns of these names are replaced. What is not a plain read of files (joined, exploded, united tables) is written
    first, so that rows made of one row of a file are told apart too."""
    if all(c in df.columns and df.schema[c].metadata == _NUMBERED for c in ("__file", "__row")):
        return df
    df = df.drop("__file", "__row")
    place = lambda file: (F.xxhash64(file).alias("__file", metadata=_NUMBERED), F.col("_metadata.row_index").alias("__row", metadata=_NUMBERED))
    if plain_read(df):
        try:
            return df.select("*", *place("_metadata.file_path"))
        except AnalysisException:  # files without row numbers
            pass
    name = F.regexp_replace("_metadata.file_name", "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    return materialize(df).select("*", *place(name))


#: Bits of the map of keys that goes to all tasks, in words of 64: some 6 MB at most, however many keys there are.
KEY_BITS = 1 << 24


def mark_likely(df: DataFrame, keys: DataFrame, *columns: str, name: str = "__likely") -> DataFrame:
    """df with a Boolean column: true for all rows whose ``columns`` are among those of keys (a table), and for a few
    others; df is not shuffled for it. An exact join of the rows that are true then moves only those."""
    place = F.pmod(F.xxhash64(*columns), F.lit(KEY_BITS))
    bit = F.expr("shiftleft(1L, cast(__place % 64 as int))")
    words = keys.select(place.alias("__place")).groupBy(F.expr("__place div 64").alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    placed = df.withColumn("__place", place).withColumn("__word", F.expr("__place div 64"))
    found = placed.join(F.broadcast(words), "__word", "left")
    likely = F.coalesce(F.expr("bit_get(__bits, cast(__place % 64 as int)) = 1"), F.lit(False))
    return found.select(*df.columns, likely.alias(name))


def likely_in(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of df that are likely among keys (see ``mark_likely``): none that is among them is missing."""
    return mark_likely(df, keys, *columns).where("__likely").drop("__likely")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each pair; equal wherever the same values stand."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of consecutive texts that lie in one byte buffer, found and hashed without a Python loop.

    start, end: byte positions; doc: the text of each word; hash: 64 bits of each word; first: index of each text's
    first word, and one more entry at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        sep = np.ones(n + 2, bool)
        sep[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        body = ~sep[1:-1]
        self.data = data
        self.start = np.flatnonzero(body & (sep[:-2] | edge[:-1]))
        self.end = np.flatnonzero(body & (sep[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = spans_hash(byte_values()[data], self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of k words within one text."""
        at = np.arange(max(0, len(self.start) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return at, spans_hash(self.hash, at, at + k)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Row range, bytes and text offsets of runs of rows with about ``limit`` bytes (a longer text stands alone)."""
    texts = batch.column(column).cast(pa.large_string())
    texts = pa.array(texts.fill_null(""), pa.large_string()) if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def byte_slices(batch: pa.RecordBatch, rows: int, limit: int, column: str = "text"):
    """Row ranges of at most ``rows`` rows and, but for a longer text alone, ``limit`` bytes of the column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > low and (held + size > limit or k - low == rows):
            yield low, k
            low, held = k, 0
        held += size
    yield low, batch.num_rows


def with_result(df: DataFrame, name: str, fields: str, compute, keep: list[str] | None = None, rows: int = 2000, limit: int = 1 << 22) -> DataFrame:
    """df with one struct column more (an input column of that name is replaced); ``compute`` maps a record batch to a
    list of dicts or None. keep: the input columns to pass on, all by default."""
    from pyspark.sql import types as T

    kept = [c for c in (keep if keep is not None else df.columns) if c != name]
    extra = T.StructField(name, T._parse_datatype_string(fields))

    def run(batches):
        for batch in batches:
            for low, high in byte_slices(batch, rows, limit):
                part = batch.slice(low, high - low)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(compute(part), kind)], [*kept, name])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(extra.dataType)
    return df.drop(name).mapInArrow(run, T.StructType([df.schema[c] for c in kept] + [extra]))
