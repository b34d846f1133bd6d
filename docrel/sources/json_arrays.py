"""Files that hold one JSON array each, read by many tasks.

Spark's text reader splits a file of any size at commas, which are never part of another character. Whether a comma
stands between elements depends on all that comes before it: the state is whether a string is open and how many brackets
are. A first job reads each block of a file and tells, for either state of strings that it may begin with, how it
ends and how many commas stand at each depth; folded over the blocks (a few numbers each, on the driver) this gives
the state and the number of elements before every block. Then each block is cut into elements by itself. The pieces of
an element that goes over blocks are joined by their file and number; only those are shuffled.

Elements come in their order, files in the order of their names. Blank files and empty arrays have no elements. What
is not one JSON array is an error, where brackets don't match, before any row is returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = re.compile(r"\\.", re.DOTALL)
STATE = "file string, block long, begins int, ends int, deeper long, commas map<long, long>, blank boolean"
ELEMENT = "file long, number long, block long, text string, whole boolean"


def passed(text: str, in_string: int, depth: int) -> tuple[int, int]:
    """The state after a text between two commas."""
    if "\\" in text:
        text = ESCAPE.sub("", text)
    parts = text.split('"')
    for outside in parts[in_string::2]:
        depth += outside.count("[") + outside.count("{") - outside.count("]") - outside.count("}")
    return in_string ^ (len(parts) - 1) & 1, depth


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """The texts between commas in their order within each block (file, block)."""
    texts = spark.read.option("lineSep", ",").text(path)
    return texts.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(batches):
    """((file, block), texts) for runs of rows of one block; a block may come in several runs, one after the other."""
    for batch in batches:
        files, blocks, texts = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        low = 0
        for k in range(1, len(texts) + 1):
            if k == len(texts) or (files[k], blocks[k]) != (files[low], blocks[low]):
                yield (files[low], blocks[low]), texts[low:k]
                low = k


def _states(batches):
    kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("begins", pa.int32()), ("ends", pa.int32()), ("deeper", pa.int64()), ("commas", pa.map_(pa.int64(), pa.int64())), ("blank", pa.bool_())])
    held: dict = {}
    for key, texts in _blocks(batches):
        known = held.setdefault(key, [[0, 0, Counter()], [1, 0, Counter()], True])
        for one in known[:2]:
            in_string, depth, commas = one
            for text in texts:
                in_string, depth = passed(text, in_string, depth)
                if not in_string:
                    commas[depth] += 1
            one[:2] = in_string, depth
        known[2] = known[2] and len(texts) == 1 and not texts[0].strip()
    rows = [
        {"file": file, "block": block, "begins": k, "ends": one[0], "deeper": one[1], "commas": list(one[2].items()), "blank": known[2]}
        for (file, block), known in held.items()
        for k, one in enumerate(known[:2])
    ]
    yield pa.RecordBatch.from_pylist(rows, kinds)


def block_states(parts: DataFrame) -> dict[tuple[str, int], tuple[int, int, int, int, bool]]:
    """By file and block: the file's number, and before the block: is a string open, the depth, the elements that have
    ended, and does an element begin with the block."""
    by_file: dict = defaultdict(lambda: defaultdict(dict))
    for r in parts.mapInArrow(_states, STATE).collect():
        by_file[r["file"]][r["block"]][r["begins"]] = r
    out = {}
    for number, file in enumerate(sorted(by_file)):
        in_string = depth = count = 0
        fresh = True
        for block in sorted(by_file[file]):
            r = by_file[file][block][in_string]
            out[file, block] = (number, in_string, depth, count, fresh)
            count += r["commas"].get(1 - depth, 0)
            in_string, depth = r["ends"], depth + r["deeper"]
            fresh = not in_string and depth == 1
        if in_string or depth:
            raise ValueError(f"not one JSON array: {file}")
    return out


def elements(parts: DataFrame, states: dict) -> DataFrame:
    """Elements, or the pieces of those that go over blocks; see ``ELEMENT``."""

    def cut(batches):
        at = None
        for key, texts in _blocks(batches):
            rows = []
            if key != at:
                if at is not None:
                    rows += last(at)
                at, (number, in_string, depth, count, fresh) = key, states[key]
                pieces, closed = [], False
            for text in texts:
                if closed:
                    raise ValueError(f"more than one JSON array: {key[0]}")
                begins = fresh and not pieces and count == 0
                if begins:
                    text = text.lstrip("﻿ \t\r\n")
                    if not text and depth == 0:
                        continue  # a blank file
                    if text[:1] != "[":
                        raise ValueError(f"not a JSON array: {key[0]}")
                in_string, depth = passed(text, in_string, depth)
                text = text[1:] if begins else text
                if not in_string and depth == 0:
                    closed, text = True, text.rstrip(" \t\r\n")
                    if text[-1:] != "]":
                        raise ValueError(f"text after a JSON array: {key[0]}")
                    text = text[:-1]
                pieces.append(text)
                if closed or (not in_string and depth == 1):
                    rows.append((number, count, key[1], ",".join(pieces), fresh))
                    pieces, fresh, count = [], True, count + 1
            state = (number, count, fresh, pieces)
            last = lambda of, s=state: [(s[0], s[1], of[1], ",".join(s[3]), False)] if s[3] else []
            if rows:
                yield batch_of(rows)
        if at is not None and (rows := last(at)):
            yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["file", "number", "block", "text", "whole"])

    return parts.mapInArrow(cut, ELEMENT)


def read_array_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text): the elements of every array."""
    parts = fragments(spark, path)
    found = elements(parts, block_states(parts))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), ",")
    joined = found.where("not whole").groupBy("file", "number").agg(pieces.alias("text"))
    rows = found.where("whole").select("file", "number", "text").unionAll(joined)
    return rows.where("number > 0 or trim(text) <> ''")
