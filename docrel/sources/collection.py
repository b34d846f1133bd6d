"""A Spark data source for collections of extended-JSON documents, one a line, in files of one folder.

    register(spark)
    measure_keys(spark, path, "_id long")
    spark.read.format("collection").schema("_id long, doc string").option("after", 100).option("to", 200).load(path)

Files are cut at line ends into splits of ``split_bytes``, each a partition. ``after`` and ``to`` bound the key (beyond the
one, up to and with the other; a null key is outside any bound). Where the least and greatest key of the splits have been
measured, only the splits that can hold such keys are read; files that are new or have changed since are read whole. The
bounds are options and not filters that Spark pushes down, as it keeps what it has pushed for all later uses of the same
DataFrame, whose rows would be missing then. Columns of a schema are ``doc`` (the line), ``file``, ``start`` (of its split), and one other, the key: long or string, null where it is missing,
of another kind or the line is not JSON. Blank lines are left out. Compressed files are one split each.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from posixpath import basename

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

RANGES = "_key_ranges"
BATCH_ROWS, BATCH_BYTES = 5000, 1 << 22


@dataclass
class Split(InputPartition):
    """Lines of a file that begin in [start, end); end None: the file is read to its end, through its codec if it has one."""

    file: str
    start: int = 0
    end: int | None = None
    low: object = field(default=None, compare=False)
    high: object = field(default=None, compare=False)
    measured: bool = field(default=False, compare=False)


def key_of(line: bytes, name: str, number: bool):
    """The key of a line: an int64, or its text; wrappers of one value ({"$oid": ...}, {"$numberLong": ...}) count as it."""
    try:
        key = json.loads(line)[name]
    except (ValueError, KeyError, TypeError):
        return None
    while isinstance(key, dict) and len(key) == 1 and next(iter(key)).startswith("$"):
        key = next(iter(key.values()))
    if number:
        try:
            key = int(key) if isinstance(key, (int, str)) and not isinstance(key, bool) else None
        except ValueError:
            return None
        return key if key is not None and -(1 << 63) <= key < 1 << 63 else None
    return key if isinstance(key, str) else str(key) if isinstance(key, int) and not isinstance(key, bool) else None


def inside(key, after, to) -> bool:
    """Is the key within the bounds? None is no bound; a key that is None is within no bound at all only."""
    if after is None and to is None:
        return True
    return key is not None and (after is None or key > after) and (to is None or key <= to)


def may_hold(split: Split, after, to) -> bool:
    """False only if no key of the split is within the bounds."""
    if not split.measured or (after is None and to is None):
        return True
    return split.low is not None and (after is None or split.high > after) and (to is None or split.low <= to)


class Collection(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return "_id string, doc string"

    def reader(self, schema: T.StructType) -> CollectionReader:
        return CollectionReader(schema, self.options)


class CollectionReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        keys = [f for f in schema if f.name not in ("doc", "file", "start")]
        if len(keys) != 1 or keys[0].dataType not in (T.LongType(), T.StringType()):
            raise ValueError("the schema must have one key, a long or a string, beside doc, file and start")
        if "path" not in options:
            raise ValueError("a path is needed")
        self.arrow, self.key, self.number = to_arrow_schema(schema), keys[0].name, keys[0].dataType == T.LongType()
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", 128 << 20))
        bound = int if self.number else str
        self.after, self.to = (bound(options[o]) if o in options else None for o in ("after", "to"))

    def _files(self) -> tuple[pyarrow.fs.FileSystem, list[pyarrow.fs.FileInfo], str]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        at = fs.get_file_info(root)
        found = [at] if at.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root))
        return fs, sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path), root

    def partitions(self) -> list[Split]:
        fs, files, root = self._files()
        known: dict[str, list[dict]] = {}
        for part in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{RANGES}", allow_not_found=True)):
            if part.is_file and part.base_name[0] not in "._":
                for line in fs.open_input_stream(part.path).readall().splitlines():
                    row = json.loads(line)
                    known.setdefault(row["file"], []).append(row)
        splits = []
        for f in files:
            rows = known.get(f.base_name, [])
            if rows and all((r["size"], r["changed"], r["key"], r["number"]) == (f.size, f.mtime_ns, self.key, self.number) for r in rows):
                splits += [Split(f.path, r["start"], r.get("end"), r.get("low"), r.get("high"), True) for r in sorted(rows, key=lambda r: r["start"])]
            elif pa.Codec.detect(f.path) if f.extension in ("gz", "bz2", "zst", "lz4") else False:
                splits.append(Split(f.path))
            else:
                splits += [Split(f.path, low, min(low + self.split_bytes, f.size)) for low in range(0, f.size, self.split_bytes)]
        return [s for s in splits if may_hold(s, self.after, self.to)]

    def _lines(self, split: Split) -> Iterator[bytes]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        if split.end is None:
            with fs.open_input_stream(split.file) as stream:
                yield from io.BufferedReader(stream, 1 << 20)
            return
        with io.BufferedReader(fs.open_input_file(split.file), 1 << 20) as stream:
            at = split.start
            if at:  # the line that begins before belongs to the split before
                stream.seek(at - 1)
                at += len(stream.readline()) - 1
            while at < split.end and (line := stream.readline()):
                at += len(line)
                yield line

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's single partition where none is left
            return
        held, size, first = [], 0, partition.start == 0

        def batch() -> pa.RecordBatch:
            place = {"file": basename(partition.file), "start": partition.start}
            columns = {"doc": [x.decode("utf-8", "replace") for _, x in held], self.key: [k for k, _ in held]}
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name) or [place.get(f.name)] * len(held), f.type) for f in self.arrow], schema=self.arrow)

        for line in self._lines(partition):
            line = (line.removeprefix(b"\xef\xbb\xbf") if first else line).strip(b" \t\r\n")
            first = False
            key = key_of(line, self.key, self.number) if line else None
            if line and inside(key, self.after, self.to):
                held.append((key, line))
                size += len(line)
            if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


def register(spark: SparkSession) -> None:
    """Makes format("collection") known to the session."""
    spark.dataSource.register(Collection)


def measure_keys(spark: SparkSession, path: str, key: str, split_bytes: int = 128 << 20) -> None:
    """Writes the least and greatest key of each split of the files at path, a folder, beside them. key: name and type."""
    register(spark)
    reader = CollectionReader(T._parse_datatype_string(key), {"path": path, "split_bytes": str(split_bytes)})
    fs, files, root = reader._files()
    if fs.get_file_info(f"{root}/{RANGES}").type != pyarrow.fs.FileType.NotFound:
        fs.delete_dir(f"{root}/{RANGES}")
    name = reader.key
    docs = spark.read.format("collection").schema(f"{key}, file string, start long").option("split_bytes", split_bytes).load(path)
    found = docs.groupBy("file", "start").agg(F.min(name).alias("low"), F.max(name).alias("high"))
    of = {f.base_name: f for f in files}
    splits = [(basename(s.file), s.start, s.end, of[basename(s.file)].size, of[basename(s.file)].mtime_ns, name, reader.number) for s in reader.partitions()]
    if splits:
        known = spark.createDataFrame(splits, "file string, start long, end long, size long, changed long, key string, number boolean")
        known.join(found, ["file", "start"], "left").write.json(f"{path.rstrip('/')}/{RANGES}")


def read_collection(spark: SparkSession, path: str, key: str = "_id long", after=None, to=None, split_bytes: int = 128 << 20) -> DataFrame:
    """(key, v): documents of a collection as VARIANT, those beyond a watermark and up to a key if such are given. A line
    that is not JSON is an error."""
    register(spark)
    reader = spark.read.format("collection").schema(f"{key}, doc string").option("split_bytes", split_bytes)
    for name, bound in (("after", after), ("to", to)):
        reader = reader if bound is None else reader.option(name, str(bound))
    docs = reader.load(path)
    return docs.select(docs.columns[0], F.parse_json("doc").alias("v"))
