import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docrel.llm import decontamination, lm_score, near_copies, quality, queries, secrets, substring_dedup, token_files
from docrel.llm.common import Words, table
from docrel.llm.components import connected

DOCS = "doc_id long, text string, dedup int, leaks int"


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Copies, shared passages, nulls, empty, short and very long texts, repeated rows and ids."""
    rng = random.Random(7)
    base = text_of(rng, 80)
    passage = text_of(rng, 30)
    rows = [(10, base), (11, base), (12, base + " tail"), (13, text_of(rng, 20) + " " + passage + " " + text_of(rng, 20)), (14, passage), (15, None), (16, ""), (17, " \n\t "), (18, "one two")]
    rows += [(19, passage.replace(" ", "\n")), (20, "a " * 3000), (21, "a " * 40), (22, text_of(rng, 20000)), (None, base), (10, base), (11, passage + " x"), (23, "é ü " * 30), (24, "é ü " * 31)]
    rows += [(100 + k, " ".join([*base.split()[:k], "edit", *base.split()[k + 1 :]])) for k in range(0, 80, 8)]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS), rows


def brute_dedup(rows, n=13):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if d is not None and first[tuple(w[k : k + n])] < d:
                gone |= set(range(k, k + n))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(odd_docs, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(substring_dedup, "AUTOMATON_ROWS", 5)
    df, rows = odd_docs
    got = Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == brute_dedup(rows)
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


def test_anchors_of_few_texts_and_automata_over_many_words(spark, monkeypatch):
    """A phrase of five words that recurs in two long texts makes its anchor hot; automata over more words than there are
    characters take numbers."""
    rng = random.Random(21)
    passage = text_of(rng, 13, 50)
    long = [" ".join(f"{rng.randrange(10**6)} {rng.randrange(10**6)} {rng.randrange(10**6)} the same old phrase again" for _ in range(600)) for _ in range(2)]
    rows = [(1, f"{long[0]} {passage}"), (2, f"{passage} {long[1]} {passage}"), (3, f"x {passage} y"), (4, long[0][: len(long[0]) // 2])]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_dedup(rows)
    most = substring_dedup.CHARACTERS
    for stretches, characters in ((100_000, most), (50, most), (50, 40), (100_000, 40)):
        monkeypatch.setattr(substring_dedup, "HOT_STRETCHES", stretches)
        monkeypatch.setattr(substring_dedup, "CHARACTERS", characters)
        got = substring_dedup.remove_repeats(df).collect()
        assert Counter((r["doc_id"], r["dedup"]["n_words"], r["dedup"]["n_removed"], r["dedup"]["kept"]) for r in got) == want
    monkeypatch.setattr(substring_dedup, "CHARACTERS", most)
    codes = np.arange(1, most + 40)
    with pytest.raises(UnicodeDecodeError):
        substring_dedup.as_string(codes)
    place, pattern = substring_dedup.occurrences(np.concatenate([codes, [0], codes[-13:]]), np.array([len(codes) - 13]), 13)
    assert place.tolist() == [len(codes) - 13, len(codes) + 1] and pattern.tolist() == [0, 0]


def test_words_are_found_across_texts():
    texts = [b"", b"ab c", b"c  \x0bd", b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = Words(data, np.cumsum([0, *map(len, texts)]))
    assert found.count.tolist() == [0, 2, 2, 1]
    assert found.hash[1] == found.hash[2] and len(set(found.hash.tolist())) == 4
    assert found.grams(2)[0].tolist() == [0, 2]


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows):
    """Per row: class id and links, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = defaultdict(set)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b)
    seen, out = {}, [None] * len(rows)
    for a in range(len(rows)):
        if a in seen:
            continue
        group, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        name = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        for x in group:
            seen[x] = True
            out[x] = (rows[x][0], name, len(near[x]))
    return Counter(out)


@pytest.mark.parametrize(("bucket", "block"), [(256, 512), (3, 4)])
def test_near_copies(odd_docs, monkeypatch, bucket, block):
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "BLOCK_SETS", block)
    df, rows = odd_docs
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_copies.near_copies(df).collect())
    assert got == brute_near(rows)


def test_one_of_each_class_stays(odd_docs, spark):
    df, rows = odd_docs
    kept = near_copies.keep_one(df).collect()
    classes = {(d, c) for d, c, _ in brute_near(rows) if d is not None}
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, c in classes if d == c)  # the null id is a copy of others
    unnamed = spark.createDataFrame([(None, text_of(random.Random(1), 60)), (None, text_of(random.Random(1), 60) + " x"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_links"] for r in near_copies.near_copies(unnamed).collect()) == [0, 1, 1]
    assert near_copies.keep_one(unnamed).count() == 2
    assert near_copies.near_copies(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def large_groups(spark):
    """Groups of over 256 different near copies, of which any two are near, and different texts with a common passage."""
    rng, rows = random.Random(11), []
    for size in (300, 700):
        base = text_of(rng, 100).split()
        for k in range(size):
            w = list(base)
            w[5 + k % 90] = f"x{k}"
            rows.append((len(rows) * 7 % 5003, " ".join(w)))
    passage = text_of(rng, 40)
    for _ in range(300):
        own = text_of(rng, 30)
        rows += [(len(rows) * 7 % 5003, f"{passage} {own}"), ((len(rows) + 1) * 7 % 5003, f"{passage} {own} end")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_large_groups_of_near_copies(large_groups):
    df, rows = large_groups
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_copies.near_copies(df).collect())
    assert got == brute_near(rows)


def test_pairs_of_common_passages_are_found(spark):
    """Documents of 5 out of 20 common passages, most of whose shingles lie in large buckets, and altered copies of
    some, at 0.8 to 0.98: every link to a copy is there, as all pairs say."""
    rng = random.Random(5)
    passages = [text_of(rng, 60, 5000) for _ in range(20)]
    rows = [(k, " ".join(rng.sample(passages, 5))) for k in range(1500)]
    for k in range(200):
        w = rows[k * 7][1].split()
        for _ in range(1 + k % 6):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((2000 + k, " ".join(w)))
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_near(rows)
    assert got == want and sum(n > 0 for _, _, n in want) > 350


def test_documents_of_one_template_are_not_compared(spark, monkeypatch):
    """3,000 documents share a page's template and are like no other; 40 of them have a near copy."""
    template = " ".join(f"t{k}" for k in range(100))
    own = lambda d: [f"w{d}_{k}" for k in range(60)]
    rows = [(d, f"{template} {' '.join(own(d))}") for d in range(3000)]
    rows += [(3000 + d, f"{template} {' '.join(own(d)[:-4])} other{d}") for d in range(40)]
    compared = []
    whole = near_copies.in_parts

    def watched(members):
        out = whole(members)
        compared.append(out.groupBy("comp").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0)
        return out

    monkeypatch.setattr(near_copies, "in_parts", watched)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (d % 3000 if d >= 3000 else d, int(d < 40 or d >= 3000)) for d in range(3040)}
    assert compared[0] > 4_000_000 and compared[1] == 40


def test_two_thousand_near_copies_are_one_class(spark):
    base = text_of(random.Random(12), 100).split()
    rows = [(k, " ".join([*base[: 5 + k % 90], f"x{k}", *base[6 + k % 90 :]])) for k in range(2000)]
    got = {tuple(r) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("class_id", "n_links").collect()}
    assert got == {(0, 1999)}


def test_pipeline_keeps_one_of_a_large_group(spark):
    import corpus_pipeline

    base = text_of(random.Random(12), 100).split()
    rows = [(k, " ".join([*base[: 5 + k % 90], f"x{k}", *base[6 + k % 90 :]])) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, df, "").collect()] == [0]


def test_only_rows_that_go_are_looked_up(spark, monkeypatch):
    """Rows that stay pass without a shuffle: what is looked up are the rows that go."""
    keys = []
    monkeypatch.setattr(near_copies, "mark_likely", lambda df, gone, *c, mark=near_copies.mark_likely, **k: keys.append(gone.count()) or mark(df, gone, *c, **k))
    rows = [(d, text_of(random.Random(d), 50), 5) for d in range(30)] + [(40, text_of(random.Random(7), 50), 6), (41, None, 7), (41, "", 7), (None, text_of(random.Random(8), 50), 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int")
    assert Counter(tuple(r) for r in near_copies.keep_one(df).collect()) == Counter(r for k, r in enumerate(rows) if k not in (30, 33))
    assert keys == [2]


def rows_of_generators(spark, name):
    """Rows that all generators of a column of this name have made in the session so far."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for e in (runs.apply(k).executionId() for k in range(runs.size())):
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "Generate" and f"explode({name}" in node.desc():
                found = (m for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows")
                total += sum(int(str(values.apply(m.accumulatorId())).replace(",", "")) for m in found if values.contains(m.accumulatorId()))
    return total


def test_parts_of_large_buckets_are_made_once(spark, large_groups, monkeypatch):
    """Of each set, a row for every run and hash that splits its bucket: no more, and written, as two steps read them."""
    monkeypatch.setattr(near_copies, "BUCKET", 64)
    made, written = near_copies.materialize(near_copies.features(near_copies.numbered(large_groups[0]))), []
    monkeypatch.setattr(near_copies, "materialize", lambda df, write=near_copies.materialize: written.append(write(df)) or written[-1])
    before = rows_of_generators(spark, "runs")
    near_copies.candidate_links(made, 2).collect()
    split = sum(t.count() for t in written if t.columns == ["node", "run", "bucket"])
    met = sum(t.count() for t in written if "left" in t.columns)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < split == (rows_of_generators(spark, "runs") - before) * near_copies.SPLITS
    assert split <= met * near_copies.SPLIT_RUNS * near_copies.SPLITS


def test_tables_between_steps_have_few_files(spark, monkeypatch):
    """A file of a few rows costs more than they do: with 64 shuffle partitions op5 took longer for its files than its work."""
    from docrel.llm import components

    written = []
    for module in (near_copies, components):
        monkeypatch.setattr(module, "materialize", lambda df, write=module.materialize: written.append(write(df)) or written[-1])
    base = text_of(random.Random(12), 100).split()
    rows = [(k, " ".join([*base[: 5 + k % 90], f"x{k}", *base[6 + k % 90 :]])) for k in range(600)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {tuple(r) for r in got.select("class_id", "n_links").collect()} == {(0, 599)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [len(t.inputFiles()) for t in written]
    most = 2 * spark.sparkContext.defaultParallelism
    assert len(files) > 10 and sum(n > most for n in files) <= 3  # links are counted when they are first written


def test_texts_go_to_python_by_bytes(spark, tmp_path):
    from docrel.llm import common

    spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('x', 10000) as text").write.parquet(str(tmp_path / "t"))
    sizes = lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches])], ["n"])])
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with common.small_batches(spark):
        got = [r["n"] for r in spark.read.parquet(str(tmp_path / "t")).mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 20_000_000 and max(got) < 2 * common.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_connected(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {(x, root(x)) for p in pairs if p[0] != p[1] for x in p}
    assert {tuple(r) for r in connected(spark.createDataFrame(pairs, "a int, b int")).collect()} == want


def test_components_are_never_cut_short(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert {r["root"] for r in connected(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected(path, rounds=1)


def test_stars_and_shared_pivots_take_few_tables(spark, monkeypatch):
    from docrel.llm import components

    made = []
    monkeypatch.setattr(components, "materialize", lambda df, write=components.materialize: made.append(write(df)) or made[-1])
    pivots = [(k, p) for k in range(20, 220) for p in range(20)]
    got = connected(spark.createDataFrame(pivots, "a int, b int"))
    assert {tuple(r) for r in got.collect()} == {(k, 0) for k in range(220)}
    assert len(made) == 3 and made[1].count() == 219


def test_sets_of_one_passage_are_linked_once_each(spark, monkeypatch):
    """600 sets share their rarest shingles: what is connected grows with the sets, not with sets times shingles."""
    base = text_of(random.Random(12), 100).split()
    rows = [(k, " ".join([*base[: 5 + k % 90], f"x{k}", *base[6 + k % 90 :]])) for k in range(600)]
    links = []
    monkeypatch.setattr(near_copies, "connected", lambda df: links.append(df.distinct().count()) or connected(df))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.select("class_id", "n_links").collect()} == {(0, 599)}
    assert links[1] < 3 * 600


def test_rows_that_are_likely_among_keys_are_marked(spark):
    from docrel.llm.common import mark_likely

    df = spark.range(20_000).select((F.col("id") % 100).alias("a"), (F.col("id") / 100).cast("long").alias("b"))
    keys = df.where("b = 7 or (a = 3 and b < 50)")
    got = mark_likely(df, keys, "a", "b", name="in")
    assert got.columns == ["a", "b", "in"] and got.count() == 20_000
    assert got.where("in").count() - keys.count() in range(20)
    assert got.where("in").join(keys, ["a", "b"], "left_semi").count() == keys.count() == 149
    assert mark_likely(df, keys.where("false"), "a", "b").where("__likely").isEmpty()


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "x One two y"), (2, "three"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), (7, "two"), (None, "three")], "item_id int, text string")
    got = decontamination.find_test_strings(docs, bench).select("doc_id", "leaks.n_hit", "leaks.items", "leaks.n_items").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, [7], 2), (2, 1, [], 1), (3, 0, [], 0)]


def test_decontamination(spark, odd_docs, monkeypatch):
    df, rows = odd_docs
    words = rows[0][1].split()
    bench = [(1, " ".join(words[5:30])), (2, "one two"), (3, None), (4, "..."), (None, "a"), (5, "ONE-two!"), (6, "a"), (7, "zz yy")]
    b = spark.createDataFrame(bench, "item_id int, text string")
    norm = decontamination.normal_words
    windows = defaultdict(set)
    for i, t in bench:
        w = norm(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = Counter()
    for d, t in rows:
        w, hit, items = norm(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want[d, len(w), len(hit), tuple(sorted(items))] += 1
    for limit in (500_000, 4):
        monkeypatch.setattr(decontamination, "TABLE_WINDOWS", limit)
        got = decontamination.find_test_strings(df, b).select("doc_id", "leaks.n_words", "leaks.n_hit", "leaks.items").collect()
        assert Counter((*r[:3], tuple(r["items"])) for r in got) == want
    none = decontamination.find_test_strings(df, b.limit(0)).select("leaks.n_hit").collect()
    assert {r[0] for r in none} == {0}


SECRETS = "x password = 'abcdefghijkl' AKIAABCDEFGHIJKLMN0 TOKEN:short deadbeefdeadbeef0 é api_key=\"aaaaaaaaaaaaaaa\" token=my_secret\": abcdefghijklmnop AKIAAKIAAB \U0001f600 secret=0123456789abcdef ghp_" + "a1" * 18


def brute_spans(text):
    import re

    out = []
    for rank, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return sorted(out)


def test_secrets(spark):
    rows = [(1, SECRETS), (2, None), (3, ""), (None, SECRETS), (1, "plain"), (4, "a" * 40 + "g" + "0" * 15), (5, "passwd:" + "z" * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))
    got = secrets.scan_secrets(df)
    want = Counter((d, str(brute_spans(t))) for d, t in rows)
    assert Counter((r["doc_id"], str([tuple(s) for s in r["spans"]])) for r in got.select("doc_id", F.transform("spans", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])).alias("spans")).collect()) == want
    assert secrets.scan_secrets(df.limit(0)).collect() == []
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_trigram_queries_are_mandatory():
    rng = random.Random(9)
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        if rule.kind == "hex":
            assert query is None
            continue
        assert query and all(query)
        for text in (SECRETS, "passwd:zzzzzzzzzzzzzz", "Api-Key API_KEY = zzzzzzzzzzzzzzz"):
            if brute_spans(text) and any(r == rule.kind for *_, r in brute_spans(text)):
                low = text.lower()
                assert any(all(t in low for t in part) for part in query)
    del rng


def test_quality_on_held_out_labels(spark, corpus):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model, name="lang").join(labels, "doc_id").where(~quality.training(F.col("doc_id")))
    rows = scored.select("lang.score", "lang.predicted", F.col("quality").alias("label")).collect()
    good, bad = ([r["score"] for r in rows if r["label"] == k] for k in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9 and np.mean([r["predicted"] == r["label"] for r in rows]) > 0.88
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert [r["q"]["score"] for r in quality.score_quality(docs, model, "q").collect()] == [0.5] * 3
    one = quality.fit_quality(docs, spark.createDataFrame([(k, 1) for k in range(1, 9)], "doc_id long, quality int"))
    assert {r["q"]["predicted"] for r in quality.score_quality(docs, one, "q").collect()} == {1}


def test_language_model(spark, corpus):
    docs = table(spark, corpus, "documents").select("doc_id", "text")
    rows = [(d, t) for d, t in docs.collect()]
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "never seen Zzz"), (-3, "never seen Zzz")], "doc_id long, text string")
    model = lm_score.train(docs.where(~lm_score.held_out(F.col("doc_id"))))
    got = lm_score.score_texts(docs.unionAll(odd), model).collect()
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in lm_score.tokens(t))
    total, types = sum(counts.values()), len(counts)
    texts = dict(rows) | {-1: None, -2: "", -3: "never seen Zzz"}
    assert len(got) == len(rows) + 4
    for r in got:
        w = lm_score.tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)
    apart = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] - r["base_score"] for r in apart) > 0.15 * sum(r["n_tokens"] for r in apart)


def small_model(texts):
    counts = Counter(w for t in texts for w in lm_score.tokens(t))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    return lm_score.start_model([(w, counts[w]) for w in order], *lm_score.leaf_sums(order, [counts[w] for w in order]))


def test_words_of_any_history_are_a_distribution():
    texts = [" ".join(f"w{(k * k + d) % 1500}" for k in range(400)) for d in range(12)]
    model = small_model(texts)
    rng = np.random.default_rng(3)
    model.weights.table[:] = rng.normal(size=model.weights.table.shape)
    for before in ("", "w1", "w7 w8 never"):
        known = [w.decode() for w in model.vocabulary.known if w != lm_score.END]
        # Each word after ``before``, then the end.
        codes = model.vocabulary.coded([f"{before} {w}" for w in known])[0]
        logs = np.concatenate([model.weights.log_p(*b) for b in codes.batches()])
        at = np.cumsum(codes.lengths) - 2
        p = 10 ** (logs[at] / math.log(10) + np.where(codes.classes[at] >= lm_score.REST, np.log10(model.vocabulary.counts[codes.ids[at]] + 1.0) - model.rest[codes.classes[at], codes.leaves[at]], 0))
        end = model.vocabulary.coded([before])[0]
        p_end = np.exp(np.concatenate([model.weights.log_p(*b) for b in end.batches()])[-1])
        # Each leaf keeps one count for unseen words.
        free = 0.0
        own = model.weights
        first = np.array([0])
        context = [b for b in end.batches()][-1][3][-1:]
        for c in range(lm_score.REST, lm_score.CLASSES):
            leaves = np.arange(lm_score.SLOTS**2)
            logs = own.log_p(np.full(len(leaves), c), np.repeat(first, len(leaves)), leaves, np.repeat(context, len(leaves), axis=0))
            free += (np.exp(logs) / 10 ** model.rest[c]).sum()
        assert abs(p.sum() + p_end + free - 1) < 1e-3


def test_gradient_sums_over_rows_that_repeat_and_vanishes_at_the_outcome():
    rng = np.random.default_rng(1)
    rows, own = rng.integers(0, 9, (50, 3)), rng.integers(0, lm_score.SLOTS, 50)
    p = rng.dirichlet(np.ones(lm_score.SLOTS), 50)
    at, times, g = lm_score.row_gradient(rows, p, own)
    want = np.zeros((9, lm_score.SLOTS))
    for r, q, o in zip(rows, p, own, strict=True):
        for k in r:
            want[k] -= q
            want[k, o] += 1
    assert np.allclose(g, want[at]) and times.sum() == rows.size
    assert np.allclose(lm_score.row_gradient(rows, np.eye(lm_score.SLOTS)[own], own)[2], 0)


def test_what_tasks_moved_is_averaged_by_how_often_they_met_a_row():
    moved = [np.full((2, lm_score.SLOTS), v, np.float16).tobytes() for v in (1, 4)]
    seen = [np.array(v, np.float32).tobytes() for v in ([1, 0], [2, 0])]
    squares = [np.array(v, np.float32).tobytes() for v in ([3, 0], [6, 0])]
    got = lm_score.averaged(pd.DataFrame({"slice": [7, 7], "moved": moved, "squares": squares, "seen": seen}))
    out = np.frombuffer(got["moved"][0], np.float16).reshape(2, -1)
    assert got["slice"].tolist() == [7] and (out[0] == 3).all() and (out[1] == 0).all()
    assert np.frombuffer(got["squares"][0], np.float32).tolist() == [5, 0]


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm_score.train(none)
    got = {r["doc_id"]: r for r in lm_score.score_texts(some, model).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"], got[2]["n_tokens"]) == (3, 0, 0, 1)
    assert got[1]["base_score"] == 0 and math.isfinite(got[1]["score"]) and got[1]["score"] < 0
    assert lm_score.score_texts(none, model).count() == 0


def test_rare_words_are_joined(spark, corpus, monkeypatch):
    """With 900 known words the rest are joined from the table of counts. Counts and base are the same; contexts name known
    words by rank and others by hash, so the models differ a little."""
    docs = table(spark, corpus, "documents").select("doc_id", "text").limit(60)
    scored = lambda: {r["doc_id"]: r for r in lm_score.score_texts(docs, lm_score.train(docs)).collect()}
    plain = scored()
    monkeypatch.setattr(lm_score.most_frequent, "__defaults__", (900,))
    few = scored()
    assert few.keys() == plain.keys()
    for k, r in plain.items():
        assert (few[k]["n_tokens"], few[k]["n_known"], few[k]["train_tokens"]) == (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert few[k]["base_score"] == pytest.approx(r["base_score"], abs=1e-8)
        assert few[k]["score"] == pytest.approx(r["score"], rel=0.1)


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello, World's end", None, "", "é ß\n\n<|endoftext|> 123", "x " * 5000, "Hello, World's end", "\U0001f600 i̇ Σ"]
    rows = [(k * 3 % 7 if k < 6 else None, t) for k, t in enumerate(texts)] + [(2, "twice"), (2, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    out = str(tmp_path / "ids")
    manifest = token_files.write_token_files(df, path, out, files=3).collect()
    tok = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for d, t in order:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.read_token_files(spark, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    reader = token_files.TokenFileReader(max(manifest, key=lambda r: r["docs"])["file"])
    some = reader.doc_id(len(reader) - 1)
    assert reader.ids(reader.find(some)[-1])[-1] == 2 and reader.find(10**6) == []
    assert token_files.read_token_files(spark, token_files.write_token_files(df.limit(0), path, out + "0").collect()).collect() == []


def test_white_space_and_case_follow_the_tokenizer(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    vocabulary = {c: k for k, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    spaces = Tokenizer(models.BPE(vocabulary, []))
    spaces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    cased = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.TextEncoder(public_tokenizers.path("word_bpe_49k.json"), 2).bare is not None
    cased.normalizer = normalizers.Sequence([normalizers.NFC()])
    for k, tokenizer in enumerate((spaces, cased)):
        tokenizer.save(str(tmp_path / f"{k}.json"))
        for text in ("Ab  c\nD", "Hello WORLD's end", "", None):
            want = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u2").tobytes()
            assert token_files.TextEncoder(str(tmp_path / f"{k}.json"), 2)(text) == want


def test_token_ids_are_the_tokenizers_own(monkeypatch):
    """Random texts of apostrophes, marks, numbers, wide characters, white space and added tokens, with small caches."""
    import public_tokenizers

    monkeypatch.setattr(token_files, "CACHED", 50)
    encode, rng = token_files.TextEncoder(public_tokenizers.path("word_bpe_49k.json"), 2), random.Random(3)
    pieces = "the Don't l'\u00e9t\u00e9 \u00c9COLE 's 'S 're ''s \"'s 'vex 'llama don''t x\u00b2 \u00bd \u00b5m \u00aa\u00ba 123 a1b2 -- (foo) <|endoftext|> <|EndOfText|> foo<|startoftext|>x \u65e5\u672c\u8a9e \u0130stanbul \u03a3\u0391\u03a3 \u00df \u00d7\u00f7 _a_ \U0001f600 \u00ff\u00de".split(" ")
    pieces += ["\x85", "\xa0", "\x1c", "\x00", "\t", "\n", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 255), 39, 115, 116, rng.randint(1, 0x2FFF)])) for _ in range(rng.randint(0, 20))) for _ in range(800)]
    for low in range(0, len(texts), 100):
        for text, ids in zip(texts[low : low + 100], encode.many(texts[low : low + 100]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == encode.whole.encode(text, add_special_tokens=False).ids, text


def test_damaged_frames_are_noticed(tmp_path):
    path = str(tmp_path / "one.zst")
    writer = token_files.TokenFileWriter(path, 2)
    for k in range(3):
        writer.write(k, np.arange(50 + k, dtype="<u2").tobytes())
    writer.close()
    reader = token_files.TokenFileReader(path)
    assert reader.ids(1).tolist() == list(range(51))
    raw = bytearray((tmp_path / "one.zst").read_bytes())
    raw[int(reader.at[1]) + 12] ^= 255
    (tmp_path / "one.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017, PT011
        token_files.TokenFileReader(path).ids(1)
    assert token_files.TokenFileReader(path).ids(0).tolist() == list(range(50))


def test_pipeline(spark, corpus):
    import corpus_pipeline

    docs = table(spark, corpus, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near copies", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows and all(by[r["doc_id"]] == r["text"] for r in rows)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(40)) <= 1
    kept = sorted(set(r["doc_id"] for r in rows))
    texts = [(d, by[d]) for d in kept]
    assert all(links == 0 for _, _, links in brute_near(texts))


def test_pipeline_keeps_columns_and_odd_rows(spark, tmp_path):
    """Columns with the names of results come out as they went in; nulls, empty tables, ties and repeats don't crash."""
    import corpus_pipeline

    rng = random.Random(5)
    rows = [(k % 50 if k % 7 else None, None if k % 11 == 0 else text_of(rng, rng.choice([0, 5, 60])), "xx", rng.choice([None, "a", "b"]), -7, "mine", k) for k in range(200)]
    rows += rows[:5]
    kinds = "doc_id long, text string, lang string, source string, size int, target string, taken long"
    folder = str(tmp_path)
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 50, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", "some words of a test"), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    for some in (rows, []):
        spark.createDataFrame(some, kinds).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.columns == [*docs.columns, "shard", "slot"] if name == "sharding" else docs.columns
            got = out.collect()
            assert {(r["size"], r["target"]) for r in got} <= {(-7, "mine")} and {tuple(r)[:7] for r in got} <= {tuple(r) for r in some}


def test_every_query_is_listed():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert pq is not None


def test_weight_table_grows_with_the_corpus():
    """A larger corpus of the same words gets more rows, until tasks can't hold them; no corpus fewer than before."""
    assert lm_score.table_rows(0, 0) == 1 << 14
    assert lm_score.table_rows(400_000, 400_000) == lm_score.table_rows(400_000, 20_000_000) == 1 << 19
    assert lm_score.table_rows(400_000, 100_000_000) == lm_score.MOST_ROWS == 1 << 20


def test_rows_of_features_spread_over_the_table():
    """Nodes of one softmax, and softmaxes, put one feature's rows far apart; rows are within the table."""
    rng = np.random.default_rng(3)
    codes = np.asfortranarray(rng.integers(0, 1 << 63, (4096, 3), np.uint64))
    weights = lm_score.Weights(np.zeros((1 << 14, lm_score.SLOTS), np.float32), tuple(np.zeros((n, lm_score.SLOTS), np.float32) for n in (1, 16, 256, 256, 4096)))
    classes, none = np.full(4096, lm_score.REST + 3), np.zeros(4096, np.int64)
    asked = [rows for _, rows, _, _ in weights.decisions(classes, none, none, codes)]
    assert len(asked) == 4
    for rows in asked:
        assert rows.shape == (4096, 3) and rows.min() >= 0 and rows.max() < 1 << 14
        assert len(np.unique(rows)) > 0.95 * (1 << 14) * (1 - math.exp(-0.75))
    assert max(np.mean(a == b) for k, a in enumerate(asked) for b in asked[:k]) < 0.002


def test_words_are_found_in_arrow_as_one_by_one(spark):
    import pyarrow as pa

    odd = ["", None, " ", "A\tB\nc\x0bD\x0ce\rf  G ", "\x00\x1c x\x85y\xa0z\u2028Ä\u0130 ß", "a" * 5000, "\n\n", "end\nEnd", "😀 A😀"]
    rng = random.Random(3)
    odd += ["".join(rng.choice("aB \t\x0b\x1f\xa0é\u3000") for _ in range(rng.randrange(40))) for _ in range(200)]
    for texts in (odd, odd[5:9], []):
        for given in (texts, pa.array(["cut off", *texts], pa.string()).slice(1)):
            words, lengths = lm_score.word_lists(given)
            want = [lm_score.tokens(t)[:-1] for t in texts]
            assert words.to_pylist() == [w for t in want for w in t] and lengths.tolist() == [len(t) for t in want]
    docs = spark.createDataFrame([(t,) for t in odd], "text string")
    assert {bytes(r["word"]): r["n"] for r in lm_score.count_tokens(docs).collect()} == Counter(w for t in odd for w in lm_score.tokens(t))


def test_each_distinct_word_is_looked_up_once():
    looked_up = []

    class Watched(dict):
        def get(self, word, *default):
            looked_up.append(word)
            return super().get(word, *default)

    model = small_model(["a b c"])
    vocabulary = lm_score.replace(model.vocabulary, known=Watched(model.vocabulary.known))
    texts = ["A b new a", None, "new other new " * 50, "c"]
    coded, rare = vocabulary.coded(texts)
    assert sorted(looked_up) == sorted({w for t in texts for w in lm_score.tokens(t)})
    assert coded.ids.tolist() == [vocabulary.known[w] if w in vocabulary.known else -1 for t in texts for w in lm_score.tokens(t)]
    assert coded.lengths.tolist() == [len(lm_score.tokens(t)) for t in texts]
    assert [{r["word"]: r["n"] for r in t} for t in rare.to_pylist()] == [{b"new": 1}, {}, {b"new": 100, b"other": 50}, {}]


def test_a_step_equals_a_plain_one():
    """One batch against the gradient row by row; steep weights, whose sums leave the range of 32 bits, included."""
    model = small_model(["a b c a b d e f g", "b a c"])
    rng = np.random.default_rng(2)
    for spread in (0.1, 200):
        start = rng.normal(0, spread, model.weights.table.shape).astype(np.float32)
        own, squares_seen = lm_score.replace(model.weights, table=start.copy()), np.ones((len(start), 2), np.float32)
        (batch,) = model.vocabulary.coded(["a b c d new a b", "b a b c"])[0].batches()
        table, squares, seen = start.astype(float), np.ones(len(start)), np.ones(len(start))
        for _, rows, first, outcome in own.decisions(*batch):
            logits = table[rows].sum(1) + first
            p = np.exp(logits - logits.max(1, keepdims=True))
            g = np.eye(lm_score.SLOTS)[outcome] - p / p.sum(1, keepdims=True)
            total = np.zeros(table.shape)
            np.add.at(total, rows, g[:, None])
            np.add.at(seen, rows, 1)
            squares += (total**2).sum(1)
            table += total * (lm_score.STEP / np.sqrt(squares + 1))[:, None]
        lm_score.learn(own, squares_seen, batch)
        assert np.isfinite(own.table).all() and np.allclose(own.table, table, atol=1e-3)
        assert np.allclose(squares_seen, np.stack([squares, seen], 1), rtol=1e-3, atol=1e-3)
