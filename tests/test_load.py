import pytest
from pyspark.sql import functions as F

from docrel.operators import load as L
from docrel.operators.collect import plan_documents
from docrel.operators.versions import BUCKET, CommitConflict
from docrel.plans import nesting
from docrel.sources import documents as S
from docrel.streaming.incremental import load_new


def things(spark, low, high, mark="n"):
    rows = spark.range(low, high).select(F.col("id").alias("_id"), F.concat(F.lit(mark), "id").alias("name"), F.array(F.col("id"), F.col("id") + 1).alias("nums"))
    return S.from_table(rows, "_id")


@pytest.fixture
def catalog(spark, request):
    name = "c_" + "".join(c for c in request.node.name if c.isalnum())[:40].lower()
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")
    yield L.Catalog(spark, name, buckets=4)
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")


@pytest.fixture(scope="module")
def plan(spark):
    return nesting.relax(plan_documents(things(spark, 1, 9), "things")[0])


def state(catalog):
    """What a reader sees: rows of both tables and the watermark."""
    root = sorted(map(tuple, catalog.read("things").collect()), key=str)
    return root, sorted(map(tuple, catalog.read("things_nums").collect()), key=str), L.load_watermark(catalog, "things")


class Stop(Exception):
    pass


def test_a_load_that_fails_at_any_step_changes_nothing(spark, catalog, plan):
    L.ensure_tables(catalog, plan)
    L.load(things(spark, 1, 9), plan, catalog, watermark=True)
    before = state(catalog)
    assert len(before[0]) == 8 and len(before[1]) == 16 and before[2] == 8
    names = []
    L.load(things(spark, 1, 9), plan, catalog, watermark=True, progress=lambda done, of, name: names.append((done, of, name)))
    assert [n[0] for n in names] == list(range(names[-1][1] + 1)) and names[-1][2] == "done"
    for fail in range(len(names) - 1):

        def progress(done, of, name, fail=fail):
            if done == fail:
                raise Stop(name)

        with pytest.raises(Stop):
            L.load(things(spark, 5, 12, "new"), plan, catalog, watermark=True, progress=progress)
        assert state(catalog) == before, names[fail]
    stats = L.load(things(spark, 5, 12, "new"), plan, catalog, watermark=True)
    root, nums, mark = state(catalog)
    assert [r[0] for r in sorted(root)] == list(range(1, 12)) and len(nums) == 22 and mark == 11
    assert {r[1] for r in root if r[0] >= 5} == {f"new{k}" for k in range(5, 12)}
    assert (stats.documents, stats.without_key, stats.rows, stats.last_id) == (7, 0, {"things_nums": 14, "things": 7}, "11")
    # What the failed loads wrote goes; what is live stays.
    assert catalog.vacuum(keep=1) and state(catalog) == (root, nums, mark)


def files(catalog, table):
    return {r[0] for r in catalog.live(table, catalog.log.latest()[1]).select(F.input_file_name()).distinct().collect()}


def test_few_keys_rewrite_few_buckets(spark, catalog, plan):
    catalog.buckets = 32
    L.ensure_tables(catalog, plan)
    L.load(things(spark, 0, 2000), plan, catalog)
    before = {t: files(catalog, t) for t in ("things", "things_nums")}
    assert all(len(f) >= 18 for f in before.values())
    stats = L.load(things(spark, 100, 110, "new"), plan, catalog)
    for table, old in before.items():
        now = files(catalog, table)
        assert len(stats.rewritten[table]) <= 10 and len(old - now) <= 10
        assert len(now & old) == len(old) - len(old - now) >= 8
    assert catalog.read("things").count() == 2000 and catalog.read("things_nums").count() == 4000
    assert catalog.read("things").where("name like 'new%'").count() == 10


def test_old_rows_are_not_shuffled(spark, catalog, plan, monkeypatch):
    L.ensure_tables(catalog, plan)
    L.load(things(spark, 0, 200), plan, catalog)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []
    own = L.Commit._write
    monkeypatch.setattr(L.Commit, "_write", lambda self, table, rows: (seen.append((table, rows._jdf.queryExecution().toString())), own(self, table, rows)))
    try:
        catalog.delete_documents(plan, spark.range(0, 5).toDF("k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [t for t, _ in seen] == ["things_nums", "things"]
    for _, text in seen:
        physical = text.partition("== Physical Plan ==")[2]
        assert physical.count("SortMergeJoin") == 1 and physical.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in physical
    assert catalog.read("things").count() == 195 and catalog.read("things_nums").count() == 390


def test_deletes_appends_clears_and_earlier_commits(spark, catalog, plan):
    L.ensure_tables(catalog, plan)
    first = L.load(things(spark, 1, 6), plan, catalog).commit
    catalog.append("things", spark.createDataFrame([(9, "nine")], "mongo_id int, name string"))
    assert {r[0] for r in catalog.read("things").select("mongo_id").collect()} == {1, 2, 3, 4, 5, 9}
    catalog.delete_keys("things", "mongo_id", spark.createDataFrame([(1,), (9,), (None,), (77,)], "k int"))
    assert catalog.read("things").count() == 4 and catalog.read("things_nums").count() == 10
    catalog.delete_documents(plan, spark.createDataFrame([(2,), (2,)], "k int"))
    assert catalog.read("things").count() == 3 and catalog.read("things_nums").count() == 8
    assert catalog.read("things", first).count() == 5
    catalog.clear("things_nums")
    assert catalog.read("things_nums").count() == 0 and catalog.read("things").count() == 3
    stats = L.load(things(spark, 1, 3), plan, catalog, clear_first=True)
    assert stats.total_rows == 6 and catalog.read("things").count() == 2
    catalog.drop("things", "absent")
    assert not catalog.exists("things") and catalog.exists("things_nums")
    assert L.ensure_tables(catalog, plan) == (["things"], ["things_nums"])
    assert catalog.read("things").count() == 0


def test_two_commits_from_one_state(spark, catalog, plan):
    L.ensure_tables(catalog, plan)
    a, b = catalog.commit(), catalog.commit()
    row = spark.createDataFrame([(1, "a")], "mongo_id int, name string")
    a.append("things", "mongo_id", row)
    b.append("things", "mongo_id", row)
    a.finish()
    with pytest.raises(CommitConflict):
        b.finish()
    assert catalog.read("things").count() == 1


def test_documents_without_key_repeated_keys_and_nothing(spark, catalog, plan):
    L.ensure_tables(catalog, plan)
    texts = ['{"_id": 1, "name": "a", "nums": [1]}', '{"name": "no key"}', '{"_id": 1, "name": "b", "nums": [1, 2, 3]}', '{"_id": null}', '{"_id": 2}']
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seq long, t string").select("seq", F.parse_json("t").alias("v"))
    stats = L.load(docs, plan, catalog, watermark=True)
    assert (stats.documents, stats.without_key, stats.rows) == (5, 2, {"things_nums": 3, "things": 2})
    assert sorted(map(tuple, catalog.read("things").collect())) == [(1, "b"), (2, None)]
    none = L.load(docs.where("false"), plan, catalog, watermark=True)
    assert (none.documents, none.total_rows, none.last_id) == (0, 0, None)
    assert L.load_watermark(catalog, "things") == 2 and catalog.read("things").count() == 2


def test_texts_are_cut_to_live_widths(spark, catalog, plan):
    narrow = nesting.bind(plan, {"things": {"name": 3}})
    L.ensure_tables(catalog, narrow)
    stats = L.load(things(spark, 98, 102), plan, catalog)
    assert stats.clipped == 2 and {r["name"] for r in catalog.read("things").collect()} == {"n98", "n99", "n10"}


def test_loads_beyond_the_mark(spark, catalog, plan):
    L.ensure_tables(catalog, plan)
    rows = spark.range(1, 20).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"), F.array("id").alias("nums"))
    assert load_new(rows.where("key < 10"), "key", plan, catalog).mode == "full"
    more = load_new(rows, "key", plan, catalog)
    assert (more.mode, more.documents, more.rows, L.load_watermark(catalog, "things")) == ("incremental", 10, {"things_nums": 10, "things": 10}, 19)
    assert BUCKET not in catalog.read("things").columns


def test_documents_that_do_not_fit_are_set_apart(spark, catalog):
    good = ['{"_id": 1, "n": 5, "items": [{"q": 1}]}', '{"_id": 2, "n": 6, "items": [{"q": 2}, {"q": 3}]}']
    bad = ['{"_id": 3, "items": []}', '{"_id": 4, "n": 7, "items": [{"q": 1}, {"q": null}]}', '{"n": 8, "items": []}']
    docs = lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seq long, t string").select("seq", F.parse_json("t").alias("v"))
    strict, _ = plan_documents(docs(good), "bills")
    assert not any(c.nullable for t in strict.tables for c in t.columns)
    L.ensure_tables(catalog, strict)
    stats = L.load(docs(good + bad), strict, catalog, quarantine=True)
    assert (stats.documents, stats.without_key, stats.rejected, stats.rows) == (5, 1, 3, {"bills_items": 3, "bills": 2})
    rejects = {(r["key"], r["reason"]) for r in catalog.read(L.REJECTS).where("collection = 'bills'").collect()}
    assert rejects == {("3", "bills.n is null"), ("4", "bills_items.q is null"), (None, "no key")}
    assert '"n":8' in catalog.read(L.REJECTS).where("key is null").first()["document"]
    # A key that is there keeps its rows when its new document doesn't fit.
    again = L.load(docs(['{"_id": 1, "n": null, "items": []}']), strict, catalog, quarantine=True)
    assert again.rejected == 1 and sorted(r["n"] for r in catalog.read("bills").collect()) == [5, 6]
    assert L.load(docs(good), nesting.relax(strict), catalog, quarantine=True).rejected == 0
