import pytest
from pyspark.sql import functions as F

from docrel import cli
from docrel.operators import flatten as FL
from docrel.operators import load as L
from docrel.operators import profile as P
from docrel.operators.collect import peek_shape, plan_documents, plan_many, profile_documents
from docrel.plans import nesting, render
from docrel.plans.infer import Profile
from docrel.sources import documents as S
from docrel.streaming.incremental import load_new, load_stream

GOLDEN = """{"_id":1,"name":"Ada","addr":{"city":"X","zip":"01"},"items":[{"sku":"A","qty":1,"tags":["r","g"]},{"sku":"B","qty":2.5,"tags":[]}],"mix":1}
{"_id":2,"name":"Bo\U0001f600","addr":{"city":"Yoo"},"items":[],"mix":"one"}

{"_id":3,"name":null,"items":[{"sku":"C","qty":3}],"mix":{"k":1}}
"""


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "orders.jsonl"
    path.write_text(GOLDEN, encoding="utf-8")
    return S.read_documents(spark, str(path)).persist()


def test_profile_of_the_golden_documents(docs):
    rows, n = profile_documents(docs)
    got = {r["path"]: r for r in rows.collect()}
    assert n == 3
    assert {p: (r["parent"], r["present"], r["nulls"], dict(r["types"])) for p, r in got.items()} == {
        "_id": ("", 3, 0, {"int": 3}),
        "name": ("", 3, 1, {"string": 2, "null": 1}),
        "addr": ("", 2, 0, {"object": 2}),
        "addr.city": ("addr.", 2, 0, {"string": 2}),
        "addr.zip": ("addr.", 1, 0, {"string": 1}),
        "items": ("", 3, 0, {"array": 3}),
        "items[]": (None, 3, 0, {"object": 3}),
        "items[].sku": ("items[].", 3, 0, {"string": 3}),
        "items[].qty": ("items[].", 3, 0, {"int": 2, "double": 1}),
        "items[].tags": ("items[].", 2, 0, {"array": 2}),
        "items[].tags[]": (None, 2, 0, {"string": 2}),
        "mix": ("", 3, 0, {"int": 1, "string": 1, "object": 1}),
        "mix.k": ("mix.", 1, 0, {"int": 1}),
    }
    assert got["name"]["max_utf16"] == 4 and got["name"]["longest"] == "Bo\U0001f600" and got["name"]["distinct_values"] == ["Ada", "Bo\U0001f600"]
    assert got["items"]["array_max"] == 2 and got["items"]["array_total"] == 3
    assert (got["items[].qty"]["num_min"], got["items[].qty"]["num_max"], got["items[].qty"]["non_integral"]) == (1, 3, True)
    assert got["mix"]["dominant"] == "int" and got["addr.zip"]["fill"] == 0.5 and got["items[]"]["fill"] is None
    assert all(sum(r["types"].values()) == r["present"] for r in got.values())


def test_shape_and_strategies(docs):
    rows, n = profile_documents(docs)
    shape = nesting.describe_shape(Profile.collect(rows, n))
    assert shape == {"documents": 3, "top_arrays": ["items"], "nested_arrays": ["items[].tags"], "top_objects": ["addr"], "nested_objects": ["items[]"]}
    assert peek_shape(docs)["top_arrays"] == ["items"]
    assert nesting.strategies_for(shape) == (["deep", "hybrid", "columns"], "hybrid")
    assert [len(nesting.preview_tables(s, "orders", shape)[0]) for s in nesting.STRATEGIES] == [3, 2, 1]
    assert "items" in nesting.shape_caption(shape)


EXPECTED = {
    "deep": {
        "orders": [("mongo_id", "INT", False), ("addr_city", "NVARCHAR(16)", False), ("addr_zip", "NVARCHAR(16)", True), ("mix", "NVARCHAR(MAX)", False), ("name", "NVARCHAR(16)", True)],
        "orders_items": [("qty", "FLOAT", False), ("sku", "NVARCHAR(16)", False)],
        "orders_items_tags": [("value", "NVARCHAR(16)", False)],
    },
    "hybrid": {
        "orders": [("mongo_id", "INT", False), ("addr", "NVARCHAR(MAX)", True), ("mix", "NVARCHAR(MAX)", False), ("name", "NVARCHAR(16)", True)],
        "orders_items": [("value", "NVARCHAR(MAX)", False)],
    },
    "columns": {
        "orders": [("mongo_id", "INT", False), ("addr", "NVARCHAR(MAX)", True), ("items", "NVARCHAR(MAX)", False), ("mix", "NVARCHAR(MAX)", False), ("name", "NVARCHAR(16)", True)],
    },
}


@pytest.mark.parametrize("strategy", list(EXPECTED))
def test_plans(docs, strategy):
    plan, _ = plan_documents(docs, "orders", strategy)
    assert {t.name: [(c.name, c.sql_type, c.nullable) for c in t.columns] for t in plan.tables} == EXPECTED[strategy]


def test_many_array_files_and_bad_lines(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.json").write_text(f'[{{"_id": {2 * k}}}, {{"_id": {2 * k + 1}}}]')
    got = S.read_documents(spark, str(folder)).orderBy("seq").select(F.to_json("v").alias("x")).collect()
    assert [r["x"] for r in got] == [f'{{"_id":{k}}}' for k in range(12)]
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"_id": 1}\n\nnot json\n{"_id": 2}\n')
    assert S.bad_lines(spark, str(lines)).first()["n"] == 1
    assert S.read_json_lines(spark, str(lines), strict=False).count() == 2
    with pytest.raises(Exception, match="not JSON"):
        S.read_json_lines(spark, str(lines)).select(F.to_json("v")).collect()


def test_wrappers_have_one_key_and_depth_is_bounded(spark):
    from docrel.functions.variants import label
    from docrel.operators.walk import facts

    texts = ['{"$date": "2024-01-01T00:00:00Z"}', '{"$date": "2024-01-01T00:00:00Z", "x": 1}', '{"$ref": "a", "$id": 1}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "seq long, t string").select("seq", F.parse_json("t").alias("v"))
    assert [r["k"] for r in rows.orderBy("seq").select(label(F.col("v")).alias("k")).collect()] == ["date", "object", "object"]
    deep = spark.createDataFrame([(0, '{"a": {"b": {"c": 1}}}')], "seq long, t string").select("seq", F.parse_json("t").alias("v"))
    assert facts(deep, 3).count() == 3
    with pytest.raises(ValueError, match="deeper"):
        facts(deep, 2)


def test_flattened_rows_and_renderings(docs):
    plan, profile = plan_documents(docs, "orders")
    got = {n: sorted(map(tuple, df.drop("__clipped").collect())) for n, df in FL.flatten(docs, plan).items()}
    assert got == {
        "orders": [(1, "X", "01", "1", "Ada"), (2, "Yoo", None, "one", "Bo\U0001f600"), (3, None, None, '{"k":1}', None)],
        "orders_items": [(1, 0, 1.0, "A"), (1, 1, 2.5, "B"), (3, 0, 3.0, "C")],
        "orders_items_tags": [(1, 0, 0, "r"), (1, 0, 1, "g")],
    }
    assert FL.clipped_count(FL.flatten(docs, plan)) == 0
    ddl = render.ddl(plan)
    assert "PRIMARY KEY ([order_id], [items_idx], [tags_idx])" in ddl and "REFERENCES [dbo].[orders] ([mongo_id]) ON DELETE CASCADE" in ddl
    assert "path: $items.tags" in render.drdl("shop", plan) and '"collection": "orders"' in render.to_json(plan)
    assert "conflict at mix" in render.report(plan, profile, sampled=3)
    moved = nesting.retarget(plan, "x", "o2")
    assert [t.name for t in moved.tables] == ["o2", "o2_items", "o2_items_tags"] and moved.children[0].parent_key == "order_id"
    assert all(c.nullable for c in nesting.relax(plan).root.columns if c.name != "mongo_id")
    assert nesting.bind(plan, {"orders": {"name": 3}}).root.columns[-1].sql_type == "NVARCHAR(3)"


@pytest.mark.parametrize(("n", "mapped"), [(40, True), (29, False)])
def test_objects_with_data_as_keys(spark, n, mapped):
    rows = spark.range(n).select(F.col("id").alias("seq"), F.parse_json(F.concat(F.lit('{"_id":'), F.col("id"), F.lit(',"slots":{"k'), F.col("id"), F.lit('":'), F.col("id"), F.lit("}}"))).alias("v"))
    plan, _ = plan_documents(rows, "t")
    if mapped:
        (child,) = plan.children
        assert (child.name, child.map_key.name, child.map_key.sql_type, child.map_value.sql_type) == ("t_slots", "slots_key", "NVARCHAR(128)", "NVARCHAR(MAX)")
        assert sorted(map(tuple, FL.flatten(rows, plan)["t_slots"].drop("__clipped").collect())) == sorted((i, f"k{i}", str(i)) for i in range(n))
    else:
        assert not plan.children and len(plan.root.columns) == n + 1


def test_typed_and_variant_profiles_agree(spark):
    df = spark.createDataFrame([(1, ("a", 2.5), [("x", 1)]), (2, None, []), (3, ("bbb", None), None)], "_id int, o struct<s: string, d: double>, a array<struct<t: string, n: int>>")
    typed = {r["path"]: (r["present"] - r["nulls"], r["max_utf16"], r["num_min"], r["num_max"], r["array_total"]) for r in P.profile_typed(df, "_id").collect()}
    variant, _ = profile_documents(S.from_table(df, "_id"))
    assert typed == {r["path"]: (r["present"] - r["nulls"], r["max_utf16"], r["num_min"], r["num_max"], r["array_total"]) for r in variant.collect()}


def test_typed_and_variant_tables_agree(spark):
    from docrel.operators.collect import plan_typed
    from docrel.operators.flatten_typed import flatten_typed

    rows = [(1, ("a", 2.5), [("x", [1, 2]), ("y", [])], {"k": 1}), (2, None, [], {}), (None, ("z", 1.0), [], {}), (3, ("b" * 40, float("nan")), None, {"k": 2, "m": 3})]
    df = spark.createDataFrame(rows, "_id int, o struct<s: string, d: double>, a array<struct<t: string, n: array<int>>>, m map<string, int>")
    plan, _ = plan_typed(df.drop("m"), "things")
    got, want = flatten_typed(df, plan), FL.flatten(S.from_table(df, "_id"), plan)
    assert sorted(got) == ["things", "things_a", "things_a_n"]
    assert {n: sorted(map(str, t.collect())) for n, t in got.items()} == {n: sorted(map(str, t.select(*got[n].columns).collect())) for n, t in want.items()}
    df = df.select("_id", "m")
    plan, _ = plan_documents(S.from_table(df, "_id"), "things", min_keys=1, max_fill=1.0)
    assert {tuple(r)[:3] for r in flatten_typed(df, plan)["things_m"].collect()} == {(1, "k", "1"), (3, "k", "2"), (3, "m", "3")}


def test_paths_are_limited_in_reading_order(docs):
    from docrel.operators.walk import facts, first_paths

    assert {r["path"] for r in first_paths(facts(docs), 3).collect()} == {"_id", "addr", "addr.city"}


def test_arrays_and_lines_are_told_apart(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"_id": 1},\n {"_id": 2}]')
    assert [r["x"] for r in S.read_documents(spark, str(path)).orderBy("seq").select(F.to_json("v").alias("x")).collect()] == ['{"_id":1}', '{"_id":2}']


def test_many_collections(docs):
    plans, errors = plan_many({"orders": docs, "none": docs.where("false")})
    assert list(plans) == ["orders"] and not errors


def table_of(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"), F.array(F.col("id"), F.col("id") + 1).alias("nums"))


def test_incremental_load_twice_is_once(spark):
    catalog = L.Catalog(spark, "loaded")
    first = table_of(spark, 1, 5)
    plan = nesting.relax(plan_documents(S.from_table(first.withColumnRenamed("key", "_id"), "_id"), "things")[0])
    assert L.ensure_tables(catalog, plan) == (["things", "things_nums"], [])
    assert load_new(first, "key", plan, catalog).rows == {"things_nums": 8, "things": 4}
    assert L.load_watermark(catalog, "things") == 4
    more = load_new(table_of(spark, 1, 8), "key", plan, catalog)
    assert (more.mode, more.documents, more.last_id) == ("incremental", 3, "7")
    L.load(S.from_table(table_of(spark, 1, 8).withColumnRenamed("key", "_id"), "_id"), plan, catalog)
    assert catalog.read("things").count() == 7 and catalog.read("things_nums").count() == 14
    assert catalog.widths("things") == {"name": 16}
    catalog.delete_keys("things", "mongo_id", spark.createDataFrame([(1,)], "k int"))
    assert catalog.read("things").count() == 6
    assert L.ensure_tables(catalog, plan)[0] == []


def test_stream_load(spark, tmp_path):
    catalog = L.Catalog(spark, "streamed")
    source = str(tmp_path / "in")
    table_of(spark, 1, 5).write.parquet(source)
    plan = nesting.relax(plan_documents(S.from_table(table_of(spark, 1, 5).withColumnRenamed("key", "_id"), "_id"), "things")[0])
    L.ensure_tables(catalog, plan, recreate=True)
    for _ in range(2):
        load_stream(spark.readStream.schema(table_of(spark, 1, 2).schema).parquet(source), "key", plan, catalog, str(tmp_path / "cp")).awaitTermination(120)
        table_of(spark, 3, 9).write.mode("append").parquet(source)
    assert catalog.read("things").count() == 8


def test_command_line(docs, tmp_path):
    path = tmp_path / "o.jsonl"
    path.write_text(GOLDEN, encoding="utf-8")
    out = tmp_path / "o.sql"
    assert cli.main(["--from-file", str(path), "--collection", "orders", "--out-ddl", str(out)]) == 0
    assert "CREATE TABLE [dbo].[orders]" in out.read_text()
    none = tmp_path / "none.jsonl"
    none.write_text("\n")
    assert cli.main(["--from-file", str(none), "--collection", "orders"]) == 1


def test_a_hundred_thousand_data_keys_are_a_key_value_table(spark):
    from docrel.operators.profile import above

    entries = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.concat(F.lit('"k'), F.col("id") * 100 + k, F.lit('": {"a": '), k, F.lit(', "b": "x"}'))), ", ")
    text = F.concat(F.lit('{"_id": '), F.col("id"), F.lit(', "slots": {'), entries, F.lit('}, "name": "n", "after": [1]}'))
    docs = spark.range(1000).select(F.col("id").alias("seq"), F.parse_json(text).alias("v"))
    plan, profile = plan_documents(docs, "t")
    assert not profile.truncated and sorted(profile.stats) == ["_id", "after", "after[]", "name", "slots"]
    assert [(t.name, t.kind) for t in plan.tables] == [("t", "root"), ("t_after", "array"), ("t_slots", "map")]
    assert (plan.children[1].keys_seen, plan.children[1].map_value.sql_type) == (100_000, "NVARCHAR(MAX)")
    assert spark.range(1).select(above(F.lit("a.b[].c"))).first()[0] == ["a", "a.b", "a.b[]"]


@pytest.mark.parametrize("n", [49, 50, 51, 99, 400, 3000])
def test_distinct_values_up_to_the_limit(spark, n):
    df = spark.range(6000).select(F.col("id").alias("_id"), F.when(F.col("id") % 13 > 0, F.concat(F.lit("v"), F.col("id") % n)).alias("x"), F.repeat(F.lit("y"), F.lit(201)).alias("long"))
    want = sorted(f"v{k}" for k in range(n)) if n <= 50 else None
    typed = {r["path"]: r["distinct_values"] for r in P.profile_typed(df, "_id").collect()}
    variant, _ = profile_documents(S.from_table(df, "_id"))
    assert typed == {r["path"]: r["distinct_values"] for r in variant.collect()} == {"_id": [], "x": want, "long": []}


def test_twenty_collections_in_one_pass(spark, monkeypatch):
    from docrel.operators import collect

    texts = [(c, k, f'{{"_id": {k}, "f{c}": {{"x": "{"y" * c}"}}, "a": [{{"n": 1.5}}]}}') for c in range(20) for k in range(3)]
    rows = spark.createDataFrame([*texts, (7, 9, "not json")], "c int, seq long, t string").withColumn("v", F.try_parse_json("t"))
    collections = {f"c{c}": rows.where(F.col("c") == c).select("seq", "v") for c in range(20)}
    passes = []
    own = collect._plan_all
    monkeypatch.setattr(collect, "_plan_all", lambda *a, **b: (passes.append(1), own(*a, **b))[1])
    plans, errors = collect.plan_many(collections | {"none": rows.where("false"), "odd": rows.select("c")})
    assert sorted(plans) == sorted(set(collections) - {"c7"}) and len(passes) == 1
    assert errors["c7"] == "1 documents are not JSON" and set(errors) == {"c7", "odd"}
    for name, plan in plans.items():
        alone = plan_documents(collections[name], name)[0]
        assert plan == alone and plan.documents == 3
    # One that fails while it is read does not take the others with it.
    broken = rows.where("c = 3").select("seq", F.parse_json(F.concat(F.lit("{"), "t")).alias("v"))
    plans, errors = collect.plan_many({"good": collections["c1"], "bad": broken})
    assert list(plans) == ["good"] and list(errors) == ["bad"]


def test_keys_with_quotation_marks(spark):
    text = r"""{"_id": 1, "a\"b": 5, "c'd": {"e\"f": "x"}, "g\"h'i": {"j": true}}"""
    docs = spark.createDataFrame([(0, text)], "seq long, t string").select("seq", F.parse_json("t").alias("v"))
    plan, _ = plan_documents(docs, "odd")
    row = FL.flatten(docs, plan)["odd"].drop("__clipped").first().asDict()
    assert sorted(map(str, row.values())) == sorted(map(str, [1, 5, "x", True]))


def test_types_of_key_value_tables_are_counted(spark):
    value = F.when(F.col("id") % 4 == 0, F.lit("null")).when(F.col("id") % 4 == 1, F.lit('"s"')).otherwise(F.col("id").cast("string"))
    docs = spark.range(40).select(F.col("id").alias("seq"), F.parse_json(F.concat(F.lit('{"_id": '), F.col("id"), F.lit(', "m": {"k'), F.col("id"), F.lit('": '), value, F.lit("}}"))).alias("v"))
    plan, _ = plan_documents(docs, "t")
    assert plan.children[0].map_value.types == {"int": 20, "string": 10}


def test_notes_and_previews(docs):
    from docrel.plans.infer import PathStats, declared_type

    stat = lambda types, **more: PathStats("p", "", 9, 0, types, next(iter(types)), **more)
    assert declared_type(stat({"string": 9}, max_utf16=500))[1] == ["up to 500 UTF-16 units, too wide for an index key"]
    assert declared_type(stat({"string": 5, "int": 4}, max_utf16=500))[1] == ["type conflict: string 55.6%, int 44.4%"]
    assert declared_type(stat({"double": 9}, non_finite=True))[1] == ["NaN or infinite values become null"]
    assert declared_type(stat({"double": 5, "int": 4}, non_finite=True))[1] == ["whole and fractional numbers mixed"]
    assert declared_type(stat({"object": 9}, max_utf16=500), as_json=True)[1] == ["JSON column"]
    shape = {"top_arrays": ["a", "b"], "nested_arrays": [f"a[].n{k}" for k in range(8)], "top_objects": [], "nested_objects": []}
    assert [nesting.preview_table_count(s, shape) for s in nesting.STRATEGIES] == [11, 3, 1] and nesting.preview_table_count("deep", None) == 1
    assert nesting.preview_json("deep", shape) == [] and nesting.preview_json("hybrid", shape)[-2:] == ["a[].n5 -> JSON", "2 more -> JSON"]
    assert nesting.preview_json("columns", shape)[0] == "a -> JSON" and nesting.preview_json("hybrid", None) == []


def test_texts_that_are_true(spark):
    from docrel.functions.variants import coerce

    texts = ["\tyes\n", " TRUE ", "no", "y", "", "1\r\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", coerce(FL.at(F.parse_json(F.to_json(F.struct("t"))), "t"), "BIT")[0].alias("b"))
    assert [r["b"] for r in rows.orderBy("k").collect()] == [True, True, False, True, False, True]


def test_typed_maps_under_arrays(spark):
    from docrel.operators.flatten_typed import flatten_typed

    rows = [(1, [({"a": 1, "b": 2},), ({"b": 3, "c": 4},), (None,)]), (2, []), (3, None), (4, [({},), ({"a": 5},)])]
    df = spark.createDataFrame(rows, "_id int, boxes array<struct<m: map<string, int>>>")
    plan, _ = plan_documents(S.from_table(df, "_id"), "things", min_keys=1, max_fill=0.7)
    (name,) = [t.name for t in plan.children if t.kind == "map"]
    got = {tuple(r)[:3] for r in flatten_typed(df, plan)[name].collect()}
    assert got == {tuple(r)[:3] for r in FL.flatten(S.from_table(df, "_id"), plan)[name].collect()} == {(1, "a", "1"), (1, "b", "2"), (1, "c", "4"), (4, "a", "5")}


def test_data_keys_beyond_the_limit_of_paths_are_detected(spark, tmp_path):
    from docrel.queries import QUERIES

    lines = spark.range(8400).select((F.col("id") % 700).alias("l_orderkey"), (F.col("id") % 4200).alias("l_suppkey"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    (row,) = QUERIES["map_detection"](spark, str(tmp_path)).collect()
    assert tuple(row) == ("slots", 4200, round(1 / 700, 9), 5)


def test_known_paths_give_the_facts_of_a_walk(spark):
    from docrel.operators import walk as W

    texts = [
        '{"_id": 1, "b": {"c": {"d": null, "e": "x"}, "big": 123456789012345678901}, "a": [{"n": 1, "t": ["p", null]}, {"n": 2.5}, null], "s": "é\U0001f600"}',
        '{"_id": 2, "b": 7, "a": [], "é k.x": {"end": true}, "deep": [[1, 2], [3]]}',
        '{"_id": 3, "b": {}, "a": "none", "two": {"r": [{"q": [{"z": 1}, {"y": -0.5}]}, {}]}, "OBJECT<": 1}',
        '{"_id": 4, "b": [null], "A": {"a": 1e400}, "t`k": 2, "DECIMAL(2,1)": 1.5}',
        "[1, 2]",
        "3",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "seq long, t string").select("seq", F.parse_json("t").alias("v"))
    spread, tree = W.surveyed(docs)
    assert tree is not None and tree.levels() == W.deepest(docs) == 6
    known, walked = W._known(spread, tree, ()).collect(), W._walked(docs, 6, ()).collect()
    plain = lambda rows: sorted(repr([r[c] for c in ("seq", "path", "parent", "type", "s", "x", "n")]) for r in rows)
    assert plain(known) == plain(walked)
    order = lambda rows: [r["path"] for r in sorted(rows, key=lambda r: (r["seq"], r["ord"]))]
    assert order(known) == order(walked)
    # Shapes that don't tell the paths, or kinds, are walked.
    for odd in ('{"a": [1, "x"]}', '{"a": {"$oid": "b"}}', "{\"a'b\": 1}"):
        more = docs.unionAll(spark.createDataFrame([(10, odd)], "seq long, t string").select("seq", F.parse_json("t").alias("v")))
        assert W.surveyed(more)[1] is None and W.facts(more).count() > len(walked)
    many = spark.range(150).select(F.col("id").alias("seq"), F.parse_json(F.concat(F.lit('{"k'), F.col("id"), F.lit('": 1}'))).alias("v"))
    assert W.surveyed(many)[1] is None and W.facts(many).select("path").distinct().count() == 150


def test_keys_of_one_object_are_not_dealt_to_one_task(spark):
    """Fields meet their container where they are."""
    rows = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") == 0, "slots").otherwise(F.concat(F.lit("slots.k"), "id")).alias("path"), F.when(F.col("id") == 0, "").otherwise("slots.").alias("parent"), F.lit(1).cast("long").alias("present"),
        F.create_map(F.when(F.col("id") == 0, "object").otherwise("int"), F.lit(10).cast("long")).alias("types"), F.when(F.col("id") == 0, "object").otherwise("int").alias("dominant"), F.lit(0).cast("long").alias("max_utf16"),
    )
    filled = P.with_fill(rows, 10)
    sizes = [r["count"] for r in filled.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) == 750 and filled.agg(F.count_if(F.col("fill") == 0.1)).first()[0] == 3000
    (box,) = P.maps(filled).collect()
    # Exactly: a sum of 2999 tenths is not 299.9.
    assert (box["path"], box["keys"], box["avg_fill"], box["key_max_utf16"], box["value_types"]) == ("slots", 2999, 0.1, 5, {"int": 29990})


def test_short_way_of_coercion_agrees(spark):
    from docrel.functions.variants import coerce, coerce_shaped

    values = [
        "1", "-3000000000", "123456789012345678901", "2.5", "17.0", "1e400", "1e3", '"12"', '"true"', '"\U0001f600\U0001f600x"', "null", "true", "[1]", '{"a": 1}', '{"$oid": "0123456789abcdef01234567"}',
        '{"$numberLong": "5"}', '{"$numberDecimal": "-7.9"}', '{"$date": "2024-01-01T00:00:00Z"}', '{"$binary": {"base64": "AQI="}}', None,
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(values)], "k int, t string").select("k", F.parse_json("t").alias("v")).withColumn("s", F.schema_of_variant("v")).persist()
    for kind in ("BIT", "INT", "BIGINT", "FLOAT", "DECIMAL(38, 6)", "DATETIME2(3)", "VARBINARY(MAX)", "NVARCHAR(3)", "NVARCHAR(MAX)", "CHAR(24)"):
        pick = lambda pair: [repr(tuple(r)) for r in rows.orderBy("k").select(pair[0], pair[1]).collect()]
        assert pick(coerce_shaped(F.col("v"), kind, F.col("s"))) == pick(coerce(F.col("v"), kind)), kind
