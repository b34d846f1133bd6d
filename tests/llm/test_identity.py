import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docrel.llm import near_copies, secrets, sharding, substring_dedup
from docrel.llm.common import numbered, table


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus, "documents").select("doc_id", "text")


def derived(docs):
    """Tables in which several rows come from one row of a file."""
    small = docs.sparkSession.createDataFrame([(k,) for k in range(3)], "copy int")
    return {
        "exploded": docs.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("copy")),
        "joined": docs.crossJoin(small),
        "united": docs.withColumn("copy", F.lit(0)).unionAll(docs.withColumn("copy", F.lit(1))).unionAll(docs.withColumn("copy", F.lit(2))),
    }


def test_every_row_has_its_own_number(docs):
    n = docs.count()
    assert numbered(docs.where("doc_id % 2 = 0").withColumn("x", F.lit(1))).select("__file", "__row").distinct().count() == n // 2
    for kind, df in derived(docs).items():
        rows = numbered(df)
        assert rows.count() == rows.select("__file", "__row").distinct().count() == 3 * n, kind
        assert numbered(rows) is rows
    own = docs.withColumns({"__file": F.lit(1), "__row": F.lit(2)})
    assert numbered(own).select("__file", "__row").distinct().count() == n


def test_shards_of_derived_tables(docs):
    for kind, df in derived(docs).items():
        rows = sharding.shuffle_to_shards(df, 6).collect()
        places = {}
        for r in rows:
            places.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
        together = sum(len({s for s, _ in p}) == 1 for p in places.values())
        # Three independent rows are in one of 6 shards once in 36.
        assert len(rows) == 3 * len(places) and together < len(places) / 6, kind
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_results_of_derived_tables(docs):
    some = docs.where("doc_id < 60")
    once = Counter((r["doc_id"], r["dedup"]["n_removed"]) for r in substring_dedup.remove_repeats(some, keep=["doc_id"]).collect())
    kept = {r["doc_id"] for r in near_copies.keep_one(some).collect()}
    classes = {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in near_copies.near_copies(some).collect()}
    found = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(some).collect()}
    for kind, df in derived(some).items():
        thrice = Counter((r["doc_id"], r["dedup"]["n_removed"]) for r in substring_dedup.remove_repeats(df, keep=["doc_id"]).collect())
        assert thrice == Counter({k: 3 * n for k, n in once.items()}), kind
        rows = near_copies.keep_one(df).collect()
        has_words = {r["doc_id"] for r in some.where("trim(coalesce(text, '')) <> ''").collect()}
        assert {r["doc_id"] for r in rows} == kept and Counter(r["doc_id"] for r in rows if r["doc_id"] in has_words) == Counter(kept & has_words)
        for r in near_copies.near_copies(df).collect():
            assert (r["class_id"], r["n_copies"]) == (classes[r["doc_id"]][0], 3 * classes[r["doc_id"]][1]) or r["doc_id"] not in has_words
        spans = [(r["doc_id"], r["spans"]) for r in secrets.scan_secrets(df).collect()]
        assert len(spans) == 3 * len(found) and all(found[d] == s for d, s in spans)


def test_random_rows_of_one_text(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), "same words in every row " * 3) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_copies.keep_one(df).count() == 1
    assert sorted((r["shard"], r["slot"]) for r in sharding.shuffle_to_shards(df, 4).collect()) == [(s, k) for s in range(4) for k in range(10)]
