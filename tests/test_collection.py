"""The data source of collections: splits, keys, and filters that reach it."""

import gzip
import json

import pytest

from docrel.sources.collection import Split, key_of, measure_keys, read_collection, register


@pytest.fixture
def folder(tmp_path):
    """1,000 documents in four files, some with wrapped keys, blank lines, multi-byte texts and no last line end."""
    docs = [{"_id": k if k % 3 else {"$numberLong": str(k)}, "text": "é€😀" * (k % 7)} for k in range(1000)]
    for n in range(4):
        lines = [json.dumps(d, ensure_ascii=False) for d in docs[n * 250 : n * 250 + 250]]
        (tmp_path / f"part{n}.jsonl").write_text("\n\n".join(lines) + "\n" * (n % 2), encoding="utf-8")
    return tmp_path


def rows(df):
    return sorted((r[0], r[1]) for r in df.selectExpr("_id", "cast(v:text as string)").collect())


def test_splits_are_the_whole(spark, folder):
    whole = rows(read_collection(spark, str(folder)))
    assert whole == [(k, "é€😀" * (k % 7)) for k in range(1000)]
    for size in (1, 37, 1000):
        cut = read_collection(spark, str(folder / "part1.jsonl"), split_bytes=size if size > 1 else 501)
        assert rows(cut) == whole[250:500] and cut.rdd.getNumPartitions() > 4


def test_bounds_read_only_matching_splits(spark, folder):
    path = str(folder)
    count = lambda **o: read_collection(spark, path, split_bytes=2000, **o).rdd.getNumPartitions()
    unmeasured = count(after=900)
    measure_keys(spark, path, "_id long", 2000)
    assert (unmeasured, count(), count(after=900)) == (32, 32, 4)
    assert rows(read_collection(spark, path, after=900)) == [(k, "é€😀" * (k % 7)) for k in range(901, 1000)]
    for after, to, n in ((None, 10, 11), (4, 5, 1), (2, 10, 8), (None, -1, 0), (999, None, 0), (-1, 999, 1000)):
        found = read_collection(spark, path, after=after, to=to)
        assert found.count() == n, (after, to)
        assert found.where("_id >= 5").count() == len([k for k in range(5, 1000) if (after is None or k > after) and (to is None or k <= to)])
    assert count(after=4, to=5) == 1
    # A file that has changed is read whole, and a new one too.
    with (folder / "part0.jsonl").open("a") as f:
        f.write('\n{"_id": 5000}\n')
    (folder / "late.jsonl").write_text('{"_id": 6000}')
    assert [r[0] for r in rows(read_collection(spark, path, after=998))] == [999, 5000, 6000]
    measure_keys(spark, path, "_id long")
    assert [r[0] for r in rows(read_collection(spark, path, after=998))] == [999, 5000, 6000]


def test_odd_lines_and_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"_id": {"$oid": "b"}}\r\n   \n{"_id": "a"}\nnot JSON\n{"x": 1}\n{"_id": 1.5}\n[1]\n{"_id": 7}')
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(b'{"_id": "z"}\n' * 3))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"{}")
    register(spark)
    docs = spark.read.format("collection").load(str(tmp_path))
    assert sorted(str(r["_id"]) for r in docs.collect()) == ["7", "None", "None", "None", "None", "a", "b", "z", "z", "z"]
    measure_keys(spark, str(tmp_path), "_id string")
    after = spark.read.format("collection").option("after", "a").load(str(tmp_path))
    assert sorted(r["_id"] for r in after.collect()) == ["b", "z", "z", "z"]
    assert [key_of(b'{"_id": ' + x + b"}", "_id", True) for x in (b"1", b'"2"', b"true", b"9223372036854775808", b'{"$oid": "x"}', b"null")] == [1, 2, None, None, None, None]
    assert Split("f", 1, 2) == Split("f", 1, 2, 3, 4, True)
    with pytest.raises(Exception, match="one key"):
        spark.read.format("collection").schema("a long, b long").load(str(tmp_path)).collect()


def test_empty_folder(spark, tmp_path):
    measure_keys(spark, str(tmp_path), "_id long")
    assert read_collection(spark, str(tmp_path), after=1).collect() == []
