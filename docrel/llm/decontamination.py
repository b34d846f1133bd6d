"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of 10 consecutive words of a benchmark item is a test string (an item of fewer words is one). Test strings
of equal length m share tables over blocks of two neighbouring words: SHIFT holds how far the search may jump when a
block stands at the window's end, and jumps m-1 words over blocks that no test string has; where the shift is 0, the
bucket of that suffix block holds the test strings to compare directly.

The tables go to the tasks whole while there are at most TABLE_WINDOWS test strings of at most TABLE_BYTES; beyond that
they are written in parts of that size to the shared folder, and each task loads one part after the other for every
TEXT_BYTES of documents (about once for an input partition), so memory stays bounded and nothing is left out. Documents
are never shuffled; texts of any length are searched whole.
Null and empty texts have no words and no hits; items that are null or have no words have no test string.
Items without an id hit like others; they are not in the list of ids, and all of them together count one item;
repeated rows stay. Other columns pass through; an input column named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, with_result

WINDOW = 10
#: Test strings held by a task at once, and their bytes (some 100 MB in all); texts held while parts are loaded in turn.
TABLE_WINDOWS, TABLE_BYTES, TEXT_BYTES = 500_000, 1 << 26, 1 << 26
#: Keeps digits, letters (A-Z lower-cased) and every byte of non-ASCII characters; all else separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "struct<n_words: long, n_hit: long, spans: array<struct<start: int, end: int>>, items: array<{}>, n_items: long>"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(WORD_BYTES).split() if text else []


class WuManber:
    """Tables for test strings of one length."""

    def __init__(self, strings: dict[bytes, tuple[int, ...]], length: int):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = {}
        self.items = strings
        for string in strings:
            w = string.split(b" ")
            for end in range(self.block, length + 1):
                block = b" ".join(w[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.jump), length - end)
            self.bucket.setdefault(b" ".join(w[-self.block :]), []).append(string)

    def search(self, w: list[bytes]):
        """(first word, test string) of every occurrence, in order."""
        at, two, shift, jump, length = self.length - 1, self.block == 2, self.shift, self.jump, self.length
        n = len(w)
        while at < n:
            block = w[at - 1] + b" " + w[at] if two else w[at]
            step = shift.get(block, jump)
            if step:
                at += step
                continue
            here = b" ".join(w[at - length + 1 : at + 1])
            for string in self.bucket[block]:
                if string == here:
                    yield at - length + 1, string
            at += 1


def build(rows) -> list[WuManber]:
    by: dict[int, dict] = {}
    for length, window, items in rows:
        by.setdefault(length, {})[bytes(window)] = tuple(items)
    return [WuManber(strings, length) for length, strings in sorted(by.items())]


def id_type(benchmark: DataFrame) -> str:
    """Ids of items stay text, or are whole numbers."""
    return "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "long"


def test_strings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, window (words joined by a space), items: the distinct test strings. A null ends the items where some have no id."""

    kind = id_type(benchmark)

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = normal_words(text)
                n = min(window, len(w))
                out += [(n, b" ".join(w[k : k + n]), item) for k in range(len(w) - n + 1)] if n else []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.string() if kind == "string" else pa.int64()))], ["length", "window", "item"])

    cut_up = benchmark.select(F.col("item_id").cast(kind).alias("item_id"), "text").mapInArrow(cut, f"length int, window binary, item {kind}")
    unnamed = F.when(F.bool_or(F.col("item").isNull()), F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    return cut_up.groupBy("length", "window").agg(F.concat(F.array_sort(F.collect_set("item")), unnamed).alias("items"))


def find_test_strings(df: DataFrame, benchmark: DataFrame, name: str = "leaks", keep: list[str] | None = None) -> DataFrame:
    """df with a struct: words, words hit, merged word spans that are hit, items found."""
    strings = materialize(test_strings(benchmark))
    many = strings.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("size")).first()
    parts = max(math.ceil(many["n"] / TABLE_WINDOWS), math.ceil(many["size"] / TABLE_BYTES))
    spark = df.sparkSession
    if parts <= 1:
        tables = spark.sparkContext.broadcast([tuple(r) for r in strings.collect()])
        folder = ""
    else:
        tables = None
        folder = _write_parts(strings, parts)
    built: dict[str, list[WuManber]] = {}

    def tables_of_task():
        if tables is not None:
            if "" not in built:
                built[""] = build(tables.value)
            yield built[""]
        else:
            for k in range(parts):
                yield build(_read_part(folder, k))

    def compute(batch):
        texts = batch.column("text").to_pylist()
        sizes = [0] * len(texts)
        hits: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for found in tables_of_task():
            for k, text in enumerate(texts):
                w = normal_words(text)
                sizes[k] = len(w)
                for matcher in found:
                    for at, string in matcher.search(w):
                        hits[k].append((at, at + matcher.length))
                        items[k].update(matcher.items[string])
        out = []
        for n_words, hit, item in zip(sizes, hits, items, strict=True):
            spans: list[dict] = []
            for start, end in sorted(hit):
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(end, spans[-1]["end"])
                else:
                    spans.append({"start": start, "end": end})
            out.append({"n_words": n_words, "n_hit": sum(s["end"] - s["start"] for s in spans), "spans": spans, "items": sorted(item - {None}), "n_items": len(item)})
        return out

    return with_result(df, name, RESULT.format(id_type(benchmark)), compute, keep, *((1 << 40, TEXT_BYTES) if parts > 1 else ()))


def _write_parts(strings: DataFrame, parts: int) -> str:
    from .common import shared_dir

    folder = shared_dir(strings.sparkSession)
    strings.repartition(parts, F.xxhash64("window")).withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts))).write.partitionBy("part").parquet(folder)
    return folder


def _read_part(folder: str, k: int):
    import pyarrow.dataset as ds

    from .token_files import filesystem

    system, path = filesystem(f"{folder}/part={k}")
    for batch in ds.dataset(path, filesystem=system, format="parquet").to_batches(columns=["length", "window", "items"]):
        yield from zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_test_strings(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    named = F.array_join(F.array_sort(F.transform("leaks.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "leaks.n_words",
        "leaks.n_hit",
        "leaks.n_items",
        F.sha2(named.cast("binary"), 256).alias("items_sha256"),
        (F.col("leaks.n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with doc as (select row_number() over () as k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (select distinct item_id, n, array_to_string(w[pos:pos + n - 1], ' ') as s
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as pos
        from (select item_id, w, least(10, len(w)) as n from item) where n > 0)),
lengths as (select distinct n from win),
occ as (select k, pos, n, s from (
    select k, pos, n, array_to_string(w[pos:pos + n - 1], ' ') as s
    from (select k, w, n, unnest(range(1, len(w) - n + 2)) as pos from doc, lengths where len(w) >= n))
  where s in (select s from win)),
hit as (select k, count(distinct p) as n_hit from (select k, unnest(range(pos, pos + n)) as p from occ) group by k),
found as (select k, count(*) as n_items, string_agg(i, ',' order by i) as names
  from (select distinct k, cast(item_id as varchar) as i from occ join win using (n, s)) group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (k) left join found using (k)
"""
