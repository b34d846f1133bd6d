import json
import random

import pytest
from pyspark.sql import functions as F

from docrel.sources import documents as S
from docrel.sources.json_arrays import block_states, fragments, passed


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind < 3:
        return rng.choice([None, True, 0, -1.5, 10**12, "", "a,b", '"', "\\", '\\",[', "]{", "é你\U0001f600,", "\n\t,", "x" * rng.randrange(40), '\\\\"'])
    if kind < 6:
        return rng.randrange(1000)
    if kind < 8:
        return {rng.choice(["a", "b,c", 'q"', "[", "é"]) + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def read(spark, path):
    rows = S.read_json_array(spark, str(path)).select("seq", F.to_json("v").alias("x")).orderBy("seq").collect()
    return [(r["seq"] >> 32, r["seq"] & 0xFFFFFFFF, json.loads(r["x"])) for r in rows]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_one_file_in_many_tasks_equals_the_whole(spark, tmp_path, small_splits, layout):
    rng = random.Random(3)
    whole = [value(rng) for _ in range(120)] + [["y" * 700 + ",", {"z": [1, 2, {"w": "]," * 200}]}], "end"]
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(whole, **layout) + "\n ", encoding="utf-8")
    assert fragments(spark, str(path)).rdd.getNumPartitions() >= 8
    assert read(spark, path) == [(0, k, json.loads(json.dumps(v))) for k, v in enumerate(whole)]


def test_many_files_blank_and_empty_ones(spark, tmp_path, small_splits):
    texts = {"a": "[1, 2]", "b": "[ ]", "c": "  \n", "d": '﻿[{"k": "' + "v," * 300 + '"}]', "e": "", "f": "[[], {}, [[]]]", "g": '["only"]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = read(spark, tmp_path)
    assert [v for _, _, v in got] == [1, 2, {"k": "v," * 300}, [], {}, [[]], "only"]
    assert [k for _, k, _ in got] == [0, 1, 0, 0, 1, 2, 0]


@pytest.mark.parametrize("text", ['[1, 2', '[1, "2]', "[1]]", "[1], [2]", "[1] x", '{"a": 1}', "[1,,2]", "[1, 2,]", "x[1]", "[nope]"])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):  # noqa: B017, PT011
        read(spark, path)


def test_states_of_texts():
    assert passed('{"a": "[', 0, 1) == (1, 2) and passed('x\\"y"]', 1, 2) == (0, 1) and passed("", 1, 3) == (1, 3)


def test_only_numbers_of_blocks_reach_the_driver(spark, tmp_path, small_splits):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"a": [k, "b,"]} for k in range(100)]))
    states = block_states(fragments(spark, str(path)))
    assert len(states) > 10 and sorted(states.values())[0] == (0, 0, 0, 0, True)
    assert sorted(s[3] for s in states.values()) == [s[3] for _, s in sorted(states.items())]
