import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docrel.llm import cover_tree, mixing, sharding

VECTORS = "vec_id long, embedding array<double>"


def brute_top(rows, queries, k=5):
    out = set()
    for q, x in queries:
        best = sorted(((-int(np.dot(x, y)), i) for i, y in rows if i != q and len(x) == len(y)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_top_k_equals_brute_force_with_ties_copies_nulls_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "DATA_ROWS", 60)
    monkeypatch.setattr(cover_tree, "QUERY_ROWS", 4)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8 + (i % 3)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [(2000, [1.0, 2.0]), (2050, [0.5, 0.5]), (2001, [3.0, -1.0])]
    bad = [(3000, None), (3050, [None, 1.0]), (3100, [math.nan] * 6), (3150, [math.inf] * 6), (None, [1.0] * 6), (3200, [])]
    df = spark.createDataFrame(rows + bad, VECTORS)
    vectors = cover_tree.whole_vectors(df)
    got = cover_tree.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    whole = [(i, [math.floor(256 * c) for c in x]) for i, x in rows]
    assert {tuple(r) for r in got.collect()} == brute_top(whole, [r for r in whole if r[0] % 50 == 0])


def test_top_k_of_nothing(spark):
    vectors = cover_tree.whole_vectors(spark.createDataFrame([], VECTORS))
    assert cover_tree.top_k(vectors, vectors).collect() == []


def test_trees_cover_and_prune():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1, (300, 8)) for c in (-200, 0, 200)]).round().astype(int)
    tree = cover_tree.CoverTree(np.arange(900), x)

    def check(node):
        p = tree.points[node.start : node.end]
        assert np.sqrt(((p - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert [c.start for c in node.children] + [node.end] == [node.start] + [c.end for c in node.children]
            for c in node.children:
                assert c.radius <= node.radius / 2 + 1e-9
                check(c)

    check(tree.root)
    search = cover_tree.DualSearch(cover_tree.CoverTree(np.arange(5), x[-5:]), 3)
    search.run(tree)
    assert search.pruned > 0


def test_matrix_has_its_margins_and_law():
    rows, cells = [10, 0, 7, 13], [15, 5, 10]
    m = sharding.communication_matrix(rows, cells, 3)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m, strict=True)] == cells
    rng = random.Random(4)
    got = Counter(sharding.hypergeometric(rng, 5, 10, 6) for _ in range(20000))
    for k in range(6):
        p = math.comb(5, k) * math.comb(10, 6 - k) / math.comb(15, 6)
        assert abs(got[k] / 20000 - p) < 0.015


def test_shards_are_exact_gapless_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 5)
    rows = [(i if i % 9 else None, "same" if i % 3 else f"t{i}", 7) for i in range(500)] + [(1, "same", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shuffle_to_shards(df, 40)
    got = [tuple(r) for r in out.collect()]
    assert Counter((a, b) for a, b, *_ in got) == Counter((a, b) for a, b, _ in rows)
    sizes = Counter(s for *_, s, _ in got)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((s, k) for *_, s, k in got) == sorted((s, k) for s, n in sizes.items() for k in range(n))
    again = sharding.shuffle_to_shards(df, 40).collect()
    assert sorted(map(str, again)) == sorted(map(str, out.collect()))
    assert sharding.shuffle_to_shards(df.limit(0), 40).collect() == []


def test_copies_and_neighbours_go_their_own_ways(spark, tmp_path, monkeypatch):
    """Rows of one key, null keys and neighbours in a file are as independent as any rows."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 4 > 0, F.col("id") - F.col("id") % 4).alias("doc_id"), F.lit("same").alias("text"))
    df.repartition(3, "text").write.parquet(str(tmp_path / "t"))
    got = sharding.shuffle_to_shards(spark.read.parquet(str(tmp_path / "t")), 20).select("doc_id", "shard", "slot").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    nulls = Counter(s for s, _ in by.pop(None))
    assert sum((nulls[s] - n / 4 / 20) ** 2 / (n / 4 / 20) for s in range(20)) < 45  # chi-square, 19 degrees
    triples = list(by.values())
    together = sum(len({s for s, _ in t}) == 1 for t in triples)
    assert together < 20  # 1500 / 400 expected
    beside = sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for t in triples for a, b in zip(sorted(t), sorted(t)[1:], strict=False))
    assert beside < 10
    first, second = (np.array([t[k] for t in triples if None not in t])[:, 1] for k in (0, 1))
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.1


def test_every_arrangement_is_as_likely(spark):
    """Chi-square over the orders of three rows in two shards, by 60 seeds."""
    one = sharding.numbered(spark.range(3).select(F.col("id").alias("doc_id"))).cache()
    seen = Counter()
    for seed in range(0, 600, 10):
        got = sharding.shuffle_to_shards(one, 2, seed=seed).collect()
        seen[tuple(r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])))] += 1
    assert len(seen) == 6 and sum((seen[x] - 10) ** 2 / 10 for x in seen) < 20  # 5 degrees


def test_sharding_runs_without_python(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    plan = sharding.shuffle_to_shards(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", range(30))
def test_budgets_are_met_as_nearly_as_any_choice_can(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(0, 40), 6)
    counts = [rng.randint(1, 4) for _ in lengths]
    budget = rng.randint(0, 120)
    taken = mixing.fit(lengths, counts, budget, seed)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    assert sum(n * t for n, t in zip(lengths, taken, strict=True)) <= budget
    many = mixing.fit([3, 5, 7, 11, 200], [500] * 5, 50_001, seed)
    assert sum(n * t for n, t in zip([3, 5, 7, 11, 200], many, strict=True)) == 50_001


def test_targets_share_all_and_respect_the_limit():
    sizes = {"b": 100, "a": 10, "c": 1000, None: 50, "d": 0}
    got = mixing.targets(sizes)
    assert math.isclose(sum(got.values()), sum(sizes.values()))
    assert all(got[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert got["a"] == 30 and got["d"] == 0  # both at three times their size
    free = [s for s in got if got[s] < 3 * sizes[s]]
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    assert len({round(got[s] / weight[s], 6) for s in free}) == 1
    assert mixing.targets({}) == {}


def test_mixing_takes_near_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 17 else None, rng.choice(["x", "x", "x", "y", None])) for i in range(900)]
    rows += [(5000 + i, "same text here", "x") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        total = by.setdefault(r["source"], [0, r["target"]])
        total[0] += r["taken"]
    assert all(abs(n - t) <= 1 for n, t in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    assert mixing.mix_sources(df.limit(0)).collect() == []
