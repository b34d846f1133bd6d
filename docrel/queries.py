"""The registered queries of the core operators and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived as D
from .derived import table
from .functions import text as X
from .functions import variants as V
from .operators import flatten as FL
from .operators import profile as P
from .operators.collect import document_maps, plan_documents, plan_typed, profile_documents
from .operators.flatten_typed import flatten_typed
from .operators.load import REJECTS, Catalog, encode_key, ensure_tables, load, load_watermark, save_watermark, upserted, without_keys
from .operators.walk import facts, first_paths
from .plans import nesting, render
from .plans.infer import Profile, bi_type, declared_type
from .sources import documents as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Sources -------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey > 1000")
def scan_filter_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return S.after(table(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select count(*) as n from events where event_type = 'error'")
def estimated_count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return S.count(table(spark, sf, "events"), "event_type = 'error'")


@query("select o_orderkey, o_orderstatus from orders order by (o_orderkey * 7919) % 10007, o_orderkey limit 100")
def sample_deterministic(spark: SparkSession, sf: str) -> DataFrame:
    order = (F.col("o_orderkey") * 7919) % 10007
    return S.sample(table(spark, sf, "orders"), 100, "o_orderkey", order=order).select("o_orderkey", "o_orderstatus")


# Path facts ----------------------------------------------------------------------------------------------------------


@query("""select 'k' as path, 'int' as type, count(*) as n, cast(min(x) as double) as lo, cast(max(x) as double) as hi
from (select cast(j.value as bigint) as x from events, json_each(props) as j where j.key = 'k')""")
def facts_json_props(spark: SparkSession, sf: str) -> DataFrame:
    found = facts(D.prop_docs(spark, sf).persist())
    return found.groupBy("path", "type").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("""with o as (select count(*) as n from orders), l as (select count(*) as n from lineitem)
select path, type, n from (values ('_id', 'int'), ('status', 'string'), ('customer', 'object'), ('customer.name', 'string'), ('customer.segment', 'string'),
  ('customer.nation', 'object'), ('customer.nation.name', 'string'), ('customer.nation.region', 'string'), ('items', 'array')) v(path, type), o
union all select path, type, n from (values ('items[]', 'object'), ('items[].part', 'int'), ('items[].supp', 'int'), ('items[].qty', 'double'), ('items[].price', 'double')) v(path, type), l""")
def facts_nested(spark: SparkSession, sf: str) -> DataFrame:
    return facts(D.order_docs(spark, sf).persist()).groupBy("path", "type").agg(F.count("*").alias("n"))


@query("""select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as path,
  unnest(['int64', 'string', 'int', 'double', 'string']) as type, (select count(*) from customer) as n""")
def facts_flat(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.profile_typed(table(spark, sf, "customer"), "c_custkey")
    return rows.select("path", F.explode("types").alias("type", "n"))


_MIX = """mix as (select 'mix' as path, case event_type when 'signup' then 'int' when 'purchase' then 'double' when 'error' then 'string' when 'view' then 'object' else 'null' end as type,
  event_id, user_id, event_type from events)"""


@query(f"""with {_MIX} select path, type, count(*) as n from mix group by all
union all select 'mix.k', 'int', count(*) from mix where type = 'object'
union all select '_id', 'int', count(*) from events where event_id % 10 <> 7
union all select 'note', 'string', count(*) from events where user_id % 3 = 0""")
def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = profile_documents(D.mixed_docs(spark, sf))
    return rows.select("path", F.explode("types").alias("type", "n"))


@query(f"""with {_MIX}, t as (select type, count(*) as n, min(event_id) as first from mix where type <> 'null' group by type)
select 'mix' as path, (select count(*) from mix) as present, (select count(*) from mix where type = 'null') as nulls, (select arg_max(type, (n, -first)) from t) as dominant
union all select 'mix.k', count(*), 0, 'int' from mix where type = 'object'
union all select '_id', count(*), 0, 'int' from events where event_id % 10 <> 7
union all select 'note', count(*), 0, 'string' from events where user_id % 3 = 0""")
def presence_dominant_type(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = profile_documents(D.mixed_docs(spark, sf))
    return rows.select("path", "present", "nulls", "dominant")


@query("""select 'mix' as path, 1.0 :: double as fill union all select 'mix.k', 1.0
union all select '_id', (select count(*) from events where event_id % 10 <> 7) / (select count(*) from events)
union all select 'note', (select count(*) from events where user_id % 3 = 0) / (select count(*) from events)""")
def fill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = profile_documents(D.mixed_docs(spark, sf))
    return rows.select("path", "fill")


@query("""select path from (values ('_id'), ('customer'), ('customer.name'), ('customer.nation'), ('customer.nation.name')) v(path) where exists (select 1 from orders)""")
def path_cap(spark: SparkSession, sf: str) -> DataFrame:
    return first_paths(facts(D.order_docs(spark, sf).persist()), 5)


# Measures of the profile ----------------------------------------------------------------------------------------------

_UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


@query(f"""select 'documents' as source, lang as part, cast(max({_UNITS.format("text")}) as bigint) as units from documents group by lang
union all select 'pages', 'html', cast(max({_UNITS.format("html")}) as bigint) from pages""")
def max_utf16(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").groupBy(F.col("lang").alias("part")).agg(F.max(X.utf16_len(F.col("text"))).alias("units"))
    pages = table(spark, sf, "pages").agg(F.lit("html").alias("part"), F.max(X.utf16_len(F.col("html"))).alias("units"))
    return docs.select(F.lit("documents").alias("source"), "*").unionByName(pages.select(F.lit("pages").alias("source"), "*"))


@query("select lang, arg_max(left(text, 80), (length(text), -doc_id)) as longest from documents group by lang")
def longest_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.max_by(F.left("text", F.lit(80)), F.struct(X.utf16_len(F.col("text")), -F.col("doc_id"))).alias("longest"))


def _distinct_sql() -> str:
    cols = [("orders", c) for c in ("o_orderstatus", "o_orderpriority")] + [("part", c) for c in ("p_name", "p_brand", "p_type")]
    return " union all ".join(
        f"select '{c}' as path, case when count(distinct {c}) <= 50 then string_agg(distinct {c}, '|' order by {c}) end as distinct_values from {t} where length({c}) <= 200" for t, c in cols
    )


@query(_distinct_sql())
def bounded_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.profile_typed(table(spark, sf, "orders"), "o_orderkey").unionByName(P.profile_typed(table(spark, sf, "part"), "p_partkey"))
    return rows.where("element_at(types, 'string') > 0").select("path", F.array_join("distinct_values", "|").alias("distinct_values"))


def _range_sql() -> str:
    return " union all ".join(
        f"select '{c}' as path, cast(min({c}) as double) as num_min, cast(max({c}) as double) as num_max, {odd} as non_integral, count(*) as present from lineitem"
        for c, odd in [(c, "false") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [(c, f"bool_or({c} <> trunc({c}))") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    )


@query(_range_sql())
def numeric_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.profile_typed(table(spark, sf, "lineitem"), "l_orderkey")
    return rows.where("num_min is not null").select("path", "num_min", "num_max", "non_integral", "present")


@query("""select 'messages' as path, max(n) as array_max, cast(sum(n) as bigint) as array_total from (select count(*) as n from conversations group by conv_id)
union all select 'embedding', max(len(embedding)), cast(sum(len(embedding)) as bigint) from embeddings""")
def array_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.profile_typed(D.conversation_rows(spark, sf), "_id").unionByName(P.profile_typed(table(spark, sf, "embeddings"), "vec_id"))
    return rows.where("dominant = 'array'").select("path", "array_max", "array_total")


_LINES = "(select count(*) from lineitem)"


@query(f"""with o as (select * from orders), c as (select * from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join orders on o_custkey = c_custkey)
select '_id' as path, count(*) as present, cast(0 as bigint) as max_utf16, min(o_orderkey) :: double as num_min, max(o_orderkey) :: double as num_max from o
union all select 'status', count(*), max(length(o_orderstatus)), null, null from o
union all select 'customer', count(*), 0, null, null from o
union all select 'customer.name', count(*), max(length(c_name)), null, null from c
union all select 'customer.segment', count(*), max(length(c_mktsegment)), null, null from c
union all select 'customer.nation', count(*), 0, null, null from o
union all select 'customer.nation.name', count(*), max(length(n_name)), null, null from c
union all select 'customer.nation.region', count(*), max(length(r_name)), null, null from c
union all select 'items', count(*), 0, null, null from o
union all select 'items[]', {_LINES}, 0, null, null
union all select 'items[].part', count(*), 0, min(l_partkey), max(l_partkey) from lineitem
union all select 'items[].supp', count(*), 0, min(l_suppkey), max(l_suppkey) from lineitem
union all select 'items[].qty', count(*), 0, min(l_quantity), max(l_quantity) from lineitem
union all select 'items[].price', count(*), 0, min(l_extendedprice), max(l_extendedprice) from lineitem""")
def profile_nested(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.profile_typed(D.order_rows(spark, sf), "_id")
    return rows.select("path", "present", "max_utf16", "num_min", "num_max")


# Maps, types, shapes ---------------------------------------------------------------------------------------------------


@query("""with slot as (select distinct l_orderkey, l_suppkey from lineitem), docs as (select count(distinct l_orderkey) as n from lineitem),
child as (select l_suppkey, count(*) / (select n from docs) as fill from slot group by l_suppkey)
select 'slots' as path, count(*) as keys, round(avg(fill), 9) as avg_fill, cast(max(length(concat('s', l_suppkey))) as bigint) as key_max_utf16 from child
having count(*) >= 30 and avg(fill) <= 0.2""")
def map_detection(spark: SparkSession, sf: str) -> DataFrame:
    return document_maps(D.slot_docs(spark, sf)).select("path", "keys", F.round("avg_fill", 9).alias("avg_fill"), "key_max_utf16")


@query("""with o as (select count(*) as n, count(distinct o_custkey) as k, max(length(concat('c', o_custkey, '_', o_orderkey))) as u from orders)
select 'slots' as path, n as keys, cast(1.0 / n as double) as avg_fill, cast(u as bigint) as key_max_utf16, false as truncated, 1 as maps, cast(n as bigint) as ints from o""")
def map_of_very_many_keys(spark: SparkSession, sf: str) -> DataFrame:
    """An object with more data keys than the limit of paths (from sf0.01 on): a key/value table, and no truncated
    profile."""
    orders = table(spark, sf, "orders")
    text = F.concat(F.lit('{"_id": '), F.col("o_orderkey"), F.lit(', "slots": {"c'), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"), F.lit('": '), F.col("o_orderkey"), F.lit("}}"))
    docs = orders.select(F.col("o_orderkey").cast("long").alias("seq"), F.parse_json(text).alias("v"))
    plan, profile = plan_documents(docs, "orders")
    m = plan.children[0]
    longest = docs.agg(F.max(F.length(F.map_keys(F.try_variant_get("v", "$.slots", "map<string, variant>"))[0])).cast("long").alias("u")).first()["u"]
    row = (m.source, m.keys_seen, m.avg_fill, longest, profile.truncated, len(plan.children), m.map_value.types["int"])
    return spark.createDataFrame([row], "path string, keys long, avg_fill double, key_max_utf16 long, truncated boolean, maps int, ints long")


@query(" union all ".join(f"select '{t}' as collection, count(*) as documents, cast({n} as bigint) as columns, cast(null as varchar) as error from {t}" for t, n in (("customer", 5), ("orders", 6), ("part", 6)))
  + " union all select 'broken', null, null, concat(count(*), ' documents are not JSON') from supplier")
def plan_many_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Several collections profiled in one pass; one of them is not JSON."""
    from .operators.collect import plan_many

    collections = {t: S.from_table(table(spark, sf, t).withColumnRenamed(k, "_id"), "_id") for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))}
    collections["broken"] = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("seq"), F.try_parse_json(F.concat("s_name", F.lit("{"))).alias("v"))
    plans, errors = plan_many(collections)
    rows = [(c, p.documents, len(p.root.columns), None) for c, p in plans.items()] + [(c, None, None, e) for c, e in errors.items()]
    return spark.createDataFrame(rows, "collection string, documents long, columns long, error string")


def _bucket(units: str) -> str:
    need = f"greatest(1, ceil({units} * 1.5))"
    return "case " + " ".join(f"when {need} <= {w} then 'NVARCHAR({w})'" for w in X.WIDTHS) + " else 'NVARCHAR(MAX)' end"


@query(f"select source, {_bucket('max(length(text))')} as sql_type, {_bucket('max(length(lang))')} as lang_type from documents group by source")
def nvarchar_bucket(spark: SparkSession, sf: str) -> DataFrame:
    units = lambda c: F.max(X.utf16_len(F.col(c)))
    widths = table(spark, sf, "documents").groupBy("source").agg(units("text").alias("t"), units("lang").alias("l"))
    return widths.select("source", X.text_type(F.col("t")).alias("sql_type"), X.text_type(F.col("l")).alias("lang_type"))


_TYPED = {
    "orders": ("o_orderkey", {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": None, "o_totalprice": "FLOAT", "o_orderdate": "DATETIME2(3)", "o_orderpriority": None}),
    "part": ("p_partkey", {"p_partkey": "BIGINT", "p_name": None, "p_brand": None, "p_type": None, "p_size": "INT", "p_retailprice": "FLOAT"}),
    "customer": ("c_custkey", {"c_custkey": "BIGINT", "c_name": None, "c_nationkey": "INT", "c_acctbal": "FLOAT", "c_mktsegment": None}),
}


def _inferred(spark: SparkSession, sf: str) -> list[tuple[str, str, str, bool]]:
    out = []
    for name, (key, _) in _TYPED.items():
        df = table(spark, sf, name)
        n = df.count()
        profile = Profile.collect(P.with_fill(P.profile_typed(df, key), n), n)
        out += [(name, s.path, declared_type(s)[0], s.nullable) for s in profile.stats.values()]
    return out


def _inference_sql(value) -> str:
    return " union all ".join(
        f"select '{t}' as collection, '{c}' as path, {value(c, kind)}, count(*) filter ({c} is null) > 0 as nullable from {t}" for t, (_, cols) in _TYPED.items() for c, kind in cols.items()
    )


@query(_inference_sql(lambda c, kind: (f"'{kind}'" if kind else _bucket(f"max(length({c}))")) + " as sql_type"))
def sql_type_inference(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_inferred(spark, sf), "collection string, path string, sql_type string, nullable boolean")


_BI = {"BIGINT": "int64", "FLOAT": "float64", "DATETIME2(3)": "date", "INT": "int", None: "varchar"}


@query(_inference_sql(lambda c, kind: f"'{_BI[kind]}' as bi_type"))
def drdl_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t, c, bi_type(kind), null) for t, c, kind, null in _inferred(spark, sf)]
    return spark.createDataFrame(rows, "collection string, path string, bi_type string, nullable boolean")


@query("""select kind, paths from (values ('top_arrays', 'items'), ('nested_arrays', ''), ('top_objects', 'customer'), ('nested_objects', 'customer.nation,items[]')) v(kind, paths)
where exists (select 1 from orders)""")
def shape_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows, n = profile_documents(D.order_docs(spark, sf))
    shape = nesting.describe_shape(Profile.collect(rows, n))
    return spark.createDataFrame([(k, ",".join(v)) for k, v in shape.items() if k != "documents"], "kind string, paths string")


@query(r"""with s as (select p_partkey, regexp_replace(regexp_replace(concat(p_partkey % 3, ' ', p_name, ' é'), '[^0-9A-Za-z_]+', '_', 'g'), '_+$', '') as a,
  regexp_replace(regexp_replace(p_type, '[^0-9A-Za-z_]+', '_', 'g'), '_+$', '') as b from part)
select p_partkey, left(concat('c_', a), 120) as from_name, left(case when b = '' then 'col' else b end, 120) as from_type from s""")
def sql_ident(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.col("p_partkey") % 3, F.lit(" "), "p_name", F.lit(" é"))
    return table(spark, sf, "part").select("p_partkey", X.identifier(name).alias("from_name"), X.identifier(F.col("p_type")).alias("from_type"))


# Plans and flattening --------------------------------------------------------------------------------------------------


def _flat(docs: DataFrame, collection: str, strategy: str = "deep") -> tuple[nesting.Plan, dict[str, DataFrame]]:
    plan, _ = plan_documents(docs, collection, strategy)
    return plan, {n: df.drop("__clipped") for n, df in FL.flatten(docs, plan).items()}


def _typed(rows: DataFrame, collection: str, strategy: str = "deep") -> dict[str, DataFrame]:
    plan, _ = plan_typed(rows, collection, strategy)
    return {n: df.drop("__clipped") for n, df in flatten_typed(rows, plan).items()}


@query("""select o_orderkey as mongo_id, o_orderstatus as status, c_name as customer_name, c_mktsegment as customer_segment, n_name as customer_nation_name, r_name as customer_nation_region
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def flatten_root_deep(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(D.order_rows(spark, sf), "orders")["orders"].withColumn("mongo_id", F.col("mongo_id").cast("long"))


_ITEM = """select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as idx, * from lineitem"""


@query(f"""select l_orderkey as order_id, cast(idx as integer) as items_idx, l_partkey as part, l_suppkey as supp, l_quantity as qty, l_extendedprice as price from ({_ITEM})""")
def flatten_items(spark: SparkSession, sf: str) -> DataFrame:
    items = _typed(D.order_rows(spark, sf), "orders")["orders_items"]
    return items.withColumns({c: F.col(c).cast("long") for c in ("order_id", "part", "supp")})


@query(f"""with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as oi from orders)
select o_custkey as customer_id, cast(oi as integer) as orders_idx, cast(idx as integer) as lines_idx, l_partkey as part, l_suppkey as supp, l_quantity as qty, l_extendedprice as price
from o join ({_ITEM}) on o_orderkey = l_orderkey""")
def flatten_two_level(spark: SparkSession, sf: str) -> DataFrame:
    lines = _typed(D.customer_rows(spark, sf), "customers")["customers_orders_lines"]
    return lines.withColumns({c: F.col(c).cast("long") for c in ("customer_id", "part", "supp")})


@query(f"""select l_orderkey as order_id, cast(idx as integer) as items_idx, l_partkey as part, l_suppkey as supp, l_quantity as qty, l_extendedprice as price from ({_ITEM})""")
def flatten_items_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from schemaless documents."""
    items = _flat(D.order_docs(spark, sf), "orders")[1]["orders_items"]
    return items.withColumns({c: F.col(c).cast("long") for c in ("order_id", "part", "supp")})


def _slot_plan(docs: DataFrame) -> nesting.Plan:
    """The plan with slots as key/value rows whatever the number of suppliers at this scale."""
    return plan_documents(docs, "slot_docs", min_keys=1, max_fill=1.0)[0]


@query("""select l_orderkey as slot_doc_id, concat('s', l_suppkey) as slots_key, cast(cast(sum(l_quantity) as bigint) as varchar) as slots_value from lineitem group by l_orderkey, l_suppkey""")
def flatten_map(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.slot_docs(spark, sf)
    out = FL.flatten(docs, _slot_plan(docs))["slot_docs_slots"].drop("__clipped")
    return out.withColumn("slot_doc_id", F.col("slot_doc_id").cast("long"))


@query("""with o as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderkey % 10 as d, row_number() over (partition by o_custkey, o_orderkey % 10 order by o_orderkey) as n from orders)
select o_custkey as thing_id, concat('k', d) as slots_key, concat(o_orderstatus, o_orderkey) as slots_value from o where n = 1""")
def flatten_map_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which many have the same key, and in them keys that occur again: the first value in reading order
    wins."""
    value = F.concat(F.col("o_orderstatus"), F.col("o_orderkey"))
    text = F.concat(F.lit('{"_id": '), F.col("o_custkey"), F.lit(', "slots": {"k'), F.col("o_orderkey") % 10, F.lit('": "'), value, F.lit('"}}'))
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("seq"), F.parse_json(text).alias("v"))
    plan, _ = plan_documents(docs, "things", min_keys=1, max_fill=1.0)
    out = FL.flatten(docs, plan)["things_slots"].drop("__clipped")
    return out.withColumn("thing_id", F.col("thing_id").cast("long"))


@query("""select vec_id, cast(pos as integer) as embedding_idx, cast(embedding[pos + 1] as double) as value from (select vec_id, embedding, unnest(range(0, len(embedding))) as pos from embeddings)""")
def flatten_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rows = _typed(vectors, "vec_docs")["vec_docs_embedding"]
    return rows.select(F.col("vec_doc_id").cast("long").alias("vec_id"), "embedding_idx", "value")


@query("""select conv_id as mongo_id, cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as integer) as messages_idx, cast(turn as bigint) as turn, role, text from conversations""")
def flatten_hybrid_json(spark: SparkSession, sf: str) -> DataFrame:
    tables = _typed(D.conversation_rows(spark, sf), "conversations", "hybrid")
    value = F.parse_json("value")
    get = lambda p, t: F.try_variant_get(value, f"$.{p}", t)
    return tables["conversations_messages"].select(
        F.col("conversation_id").cast("long").alias("mongo_id"), "messages_idx", get("turn", "long").alias("turn"), get("role", "string").alias("role"), get("text", "string").alias("text")
    )


@query("""select o_orderkey as mongo_id, o_orderstatus as status, c_name as name, n_name as nation, (select count(*) from lineitem where l_orderkey = o_orderkey) as n_items
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
def flatten_columns_json(spark: SparkSession, sf: str) -> DataFrame:
    root = _typed(D.order_rows(spark, sf), "orders", "columns")["orders"]
    customer = F.parse_json("customer")
    return root.select(
        F.col("mongo_id").cast("long").alias("mongo_id"),
        "status",
        F.try_variant_get(customer, "$.name", "string").alias("name"),
        F.try_variant_get(customer, "$.nation.name", "string").alias("nation"),
        F.size(F.try_variant_get(F.parse_json("items"), "$", "array<variant>")).cast("long").alias("n_items"),
    )


@query("""select event_id as mongo_id, case when user_id % 3 = 0 then concat('n', user_id % 60) end as note from events where event_id % 10 <> 7""")
def skip_no_key(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(D.mixed_docs(spark, sf), "events")[1]["events"].select(F.col("mongo_id").cast("long").alias("mongo_id"), "note")


@query("""with o as (select count(*) as n from orders), l as (select count(*) as n from lineitem)
select 'orders' as name, 'root' as kind, cast(6 as bigint) as columns, cast(0 as bigint) as elements from o where n > 0 union all select 'orders_items', 'array', 4, n from l""")
def plan_tables(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = plan_documents(D.order_docs(spark, sf), "orders")
    return spark.createDataFrame([(t.name, t.kind, len(t.columns), t.elements) for t in plan.tables], "name string, kind string, columns long, elements long")


def _ddl_sql() -> str:
    bucket = lambda c: f"({_bucket(f'max(length({c}))')})"
    kinds = {"mongo_id": "'INT NOT NULL'", "p_brand": f"{bucket('p_brand')} || ' NOT NULL'", "p_name": f"{bucket('p_name')} || ' NOT NULL'", "p_size": "'INT NOT NULL'", "p_type": f"{bucket('p_type')} || ' NOT NULL'"}
    lines = " || ',' || chr(10) || ".join(f"'    [{c}] ' || {k}" for c, k in kinds.items())
    end = "',' || chr(10) || '    CONSTRAINT [PK_part] PRIMARY KEY ([mongo_id])' || chr(10) || ')'"
    return f"select 'part' as name, 'CREATE TABLE [dbo].[part] (' || chr(10) || {lines} || {end} as statement from part"


@query(_ddl_sql())
def ddl_statement(spark: SparkSession, sf: str) -> DataFrame:
    """The CREATE TABLE statement of part's documents."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("_id"), "p_name", "p_brand", "p_type", "p_size")
    plan, _ = plan_documents(S.from_table(rows, "_id"), "part")
    return spark.createDataFrame(render.ddl_statements(plan), "name string, statement string")


@query()
def ddl_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every rendering of the plan of nested orders."""
    plan, profile = plan_documents(D.order_docs(spark, sf), "orders")
    texts = {"ddl": render.ddl(plan), "drdl": render.drdl("shop", plan), "json": render.to_json(plan), "report": render.report(plan, profile), "spark": ";\n".join(render.spark_ddl(plan))}
    return spark.createDataFrame(list(texts.items()), "kind string, text string")


# Values ----------------------------------------------------------------------------------------------------------------


def _mixed_value(spark: SparkSession, sf: str):
    docs = D.mixed_docs(spark, sf)
    return docs.withColumn("m", FL.at(F.col("v"), "mix"))


@query("""select event_id as seq, case event_type when 'signup' then event_id <> 0 when 'purchase' then true when 'error' then false end as bit from events""")
def coerce_bit(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_value(spark, sf).select("seq", V.coerce(F.col("m"), "BIT")[0].alias("bit"))


@query("""select event_id as seq, cast(case when event_type in ('signup', 'purchase') then event_id end as integer) as small, case when event_type in ('signup', 'purchase') then event_id end as large from events""")
def coerce_int(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_value(spark, sf).select("seq", V.coerce(F.col("m"), "INT")[0].alias("small"), V.coerce(F.col("m"), "BIGINT")[0].alias("large"))


@query("""select event_id as seq, cast(case event_type when 'signup' then event_id when 'purchase' then event_id + 0.5 end as double) as number from events""")
def coerce_float(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_value(spark, sf).select("seq", V.coerce(F.col("m"), "FLOAT")[0].alias("number"))


@query("""select event_id as seq, cast(case event_type when 'signup' then event_id when 'purchase' then event_id + 0.5 end as decimal(38, 6)) as number from events""")
def coerce_decimal(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed_value(spark, sf).select("seq", V.coerce(F.col("m"), "DECIMAL(38, 6)")[0].alias("number"))


@query("""with t as (select event_id as seq, case event_type when 'signup' then cast(event_id as varchar) when 'purchase' then concat(event_id, '.5') when 'error' then concat('Yes ', user_id % 100)
  when 'view' then concat('{"k":', user_id, '}') end as whole from events)
select seq, left(whole, 4) as text, coalesce(length(whole) > 4, false) as clipped from t""")
def coerce_text(spark: SparkSession, sf: str) -> DataFrame:
    text, cut = V.coerce(F.col("m"), "NVARCHAR(4)")
    return _mixed_value(spark, sf).select("seq", text.alias("text"), cut.alias("clipped"))


@query("""select doc_id, left(text, 100) as clipped, length(text) > 100 as was_clipped from documents""")
def clip_utf16(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.clip_utf16(text, 100).alias("clipped"), (X.utf16_len(text) > 100).alias("was_clipped"))


@query("""select source, count(*) filter (length(text) > 4000) as truncated from documents group by source""")
def truncated_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.from_table(table(spark, sf, "documents").select(F.col("doc_id").alias("_id"), "text", "source"), "_id")
    cut = V.coerce(FL.at(F.col("v"), "text"), "NVARCHAR(4000)")[1]
    source = F.try_variant_get("v", "$.source", "string")
    return rows.groupBy(source.alias("source")).agg(F.count_if(cut).alias("truncated"))


@query(r"""select doc_id, case when doc_id % 2 = 0 then text else trim(regexp_replace(concat(left(text, 40), '  ', text), '[ \t]{2,}', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) end as cleaned from documents""")
def strip_emoji(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    odd = F.concat(F.left(text, F.lit(40)), F.lit(" \U0001f600‍ "), text, F.lit("\U0001f1e6"))
    return table(spark, sf, "documents").select("doc_id", X.strip_emoji(F.when(F.col("doc_id") % 2 == 0, text).otherwise(odd)).alias("cleaned"))


# Loads -------------------------------------------------------------------------------------------------------------------


@query("""select o_orderkey, o_orderstatus, case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders""")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return upserted(orders, changed, "o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0")
def delete_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return without_keys(orders, "o_orderkey", orders.where("o_orderkey % 3 = 0").select("o_orderkey"))


@query("select o_orderkey, o_custkey from orders")
def incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    mark = orders.agg((F.max("o_orderkey") / 2).cast("long")).first()[0]
    return upserted(orders.where(F.col("o_orderkey") <= mark), S.after(orders, "o_orderkey", mark), "o_orderkey")


@query("select cast(max(event_id) as varchar) as last_id, 'int' as last_id_type from events where event_id % 10 <> 7")
def watermark(spark: SparkSession, sf: str) -> DataFrame:
    plan, tables = _flat(D.mixed_docs(spark, sf), "events")
    return spark.createDataFrame([encode_key(tables["events"].agg(F.max("mongo_id")).first()[0], plan.key)], "last_id string, last_id_type string")


@query("""with i as (select count(*) as n from lineitem left join orders on l_orderkey = o_orderkey where o_orderkey is null)
select n as orphans, cast(0 as bigint) as duplicates from i""")
def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Items without an order, and keys of items that occur twice, after flattening."""
    tables = _typed(D.order_rows(spark, sf), "orders")
    items = tables["orders_items"]
    orphans = items.join(tables["orders"], items["order_id"] == tables["orders"]["mongo_id"], "left_anti").select(F.lit("orphan").alias("kind"))
    twice = items.groupBy("order_id", "items_idx").count().where("count > 1").select(F.lit("duplicate").alias("kind"))
    found = orphans.unionAll(twice)
    return found.agg(F.count_if(F.col("kind") == "orphan").alias("orphans"), F.count_if(F.col("kind") == "duplicate").alias("duplicates"))


@query(f"""select 'o_orderstatus' as name, {_bucket("max(length(o_orderstatus))")} as planned, 'NVARCHAR(8)' as bound from orders
union all select 'o_orderpriority', {_bucket("max(length(o_orderpriority))")}, 'NVARCHAR(8)' from orders""")
def column_widths_bind(spark: SparkSession, sf: str) -> DataFrame:
    plan, _ = plan_documents(S.from_table(table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), "o_orderstatus", "o_orderpriority"), "_id"), "orders")
    bound = nesting.bind(plan, {"orders": {"o_orderstatus": 8, "o_orderpriority": 8}})
    rows = [(a.name, a.sql_type, b.sql_type) for a, b in zip(plan.root.columns, bound.root.columns, strict=True) if a.name != nesting.ROOT_KEY]
    return spark.createDataFrame(rows, "name string, planned string, bound string")


# Files, wrappers and a live catalogue ------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/docrel-{uuid.uuid4().hex}"


_NAMES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query(" union all ".join(f"select cast({k} as integer) as place, '{n}' as name, (select count(*) from {n}) as n" for k, n in enumerate(_NAMES)))
def catalog_sorted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of a schema by name, with their number of rows."""
    schema = f"names_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema}")
    for name in reversed(_NAMES):
        spark.sql(f"CREATE TABLE {schema}.{name} USING parquet LOCATION '{sf}/{name}.parquet'")
    out = None
    for k, name in enumerate(S.list_tables(spark, schema)):
        one = S.count(spark.table(f"{schema}.{name}")).select(F.lit(k).alias("place"), F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


_LINES_SQL = "select c_custkey as key, c_name as name, cast(c_acctbal as double) as balance from customer"


def _customer_json(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal")).alias("value"))


def _customers(docs: DataFrame) -> DataFrame:
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return docs.select(get("_id", "bigint").alias("key"), get("c_name", "string").alias("name"), get("c_acctbal", "double").alias("balance"))


@query(_LINES_SQL)
def json_lines_source(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    _customer_json(spark, sf).select("value").write.text(path)
    return _customers(S.read_documents(spark, path))


@query(_LINES_SQL)
def json_array_source(spark: SparkSession, sf: str) -> DataFrame:
    """Seven array files."""
    path = _folder(spark)
    parts = _customer_json(spark, sf).groupBy((F.col("c_custkey") % 7).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    parts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _customers(S.read_documents(spark, path))


@query(_LINES_SQL.replace("select c_custkey", "select true as pruned, c_custkey") + " where c_custkey > (select 0.75 * max(c_custkey) from customer)")
def collection_beyond_key(spark: SparkSession, sf: str) -> DataFrame:
    """Customers beyond three quarters of the keys, through the data source, from the splits that can hold them."""
    from .sources.collection import measure_keys, read_collection

    path = _folder(spark)
    lines = _customer_json(spark, sf)
    lines.repartitionByRange(8, "c_custkey").select("value").write.option("compression", "none").text(path)
    measure_keys(spark, path, "_id long", 1 << 20)
    mark = lines.agg(F.floor(0.75 * F.max("c_custkey"))).first()[0]
    whole, docs = read_collection(spark, path), read_collection(spark, path, after=mark)
    pruned = 2 * docs.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    return _customers(docs.select("v")).withColumn("pruned", F.lit(pruned))


@query(_LINES_SQL.replace("select c_custkey", "select true as blocks, c_custkey"))
def json_array_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """One array file of all customers, read in blocks of 16 KB."""
    from .operators.versions import setting

    path, out = _folder(spark), _folder(spark)
    lines = _customer_json(spark, sf).groupBy((F.col("c_custkey") % 8).alias("k")).agg(F.array_join(F.collect_list("value"), ",\n").alias("part"))
    whole = lines.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("part"), ", "), F.lit("\n]")).alias("value"))
    whole.write.option("compression", "none").text(path)
    with setting(spark, "spark.sql.files.maxPartitionBytes", "16k"):
        found = _customers(S.read_documents(spark, path)).withColumn("part", F.spark_partition_id())
        found.write.parquet(out)
    rows = spark.read.parquet(out)
    blocks = rows.agg((F.count_distinct("part") > 1).alias("blocks"))
    return rows.drop("part").join(F.broadcast(blocks))


def _wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """at (a date), id (an object id), bin (bytes), two (an object whose first key looks like a wrapper's)."""
    text = F.format_string(
        '{"_id": %d, "at": {"$date": {"$numberLong": "%d"}}, "id": {"$oid": "%024x"}, "bin": {"$binary": {"base64": "%s", "subType": "00"}}, "two": {"$date": "2024-01-01", "x": 1}}',
        "event_id", F.col("event_id") * 1000, "event_id", F.base64(F.col("event_type").cast("binary")),
    )
    return table(spark, sf, "events").select(F.col("event_id").cast("long").alias("seq"), F.parse_json(text).alias("v"))


@query("""select t.path, t.type, n from (select count(*) as n from events), (values ('at', 'date'), ('id', 'objectId'), ('bin', 'binary'), ('two', 'object'), ('two.$date', 'string'), ('two.x', 'int')) t(path, type)""")
def extended_json_types(spark: SparkSession, sf: str) -> DataFrame:
    return facts(_wrapped(spark, sf)).where("path <> '_id'").groupBy("path", "type").agg(F.count("*").alias("n"))


@query("select event_id as seq, epoch_ms(event_id * 1000) as at from events")
def coerce_datetime(spark: SparkSession, sf: str) -> DataFrame:
    return _wrapped(spark, sf).select("seq", V.coerce(FL.at(F.col("v"), "at"), "DATETIME2(3)")[0].alias("at"))


@query("select event_id as seq, lower(hex(event_type)) as bytes, lpad(lower(to_hex(event_id)), 24, '0') as id from events")
def coerce_binary(spark: SparkSession, sf: str) -> DataFrame:
    docs = _wrapped(spark, sf)
    raw = V.coerce(FL.at(F.col("v"), "bin"), "VARBINARY(MAX)")[0]
    return docs.select("seq", F.lower(F.hex(raw)).alias("bytes"), V.coerce(FL.at(F.col("v"), "id"), "CHAR(24)")[0].alias("id"))


@query("""with k as (select bool_or(o_orderkey % 2 = 0) as even, bool_or(o_orderkey % 2 = 1) as odd from orders)
select 'mixed' as name, case when even and odd then 'FLOAT' when even then 'INT' else 'FLOAT' end as sql_type from k
union all select 'wide', case when max(o_orderkey) * 1000000 >= 2147483648 then 'BIGINT' else 'INT' end from orders
union all select 'text', case when even and odd then 'NVARCHAR(128)' else 'INT' end from k""")
def numeric_widening(spark: SparkSession, sf: str) -> DataFrame:
    """Whole and fractional numbers, numbers beyond 32 bits, numbers and text in one field."""
    even = F.col("o_orderkey") % 2 == 0
    number = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit('{"_id": '), number, F.lit(', "mixed": '), number, F.when(even, "").otherwise(".5"), F.lit(', "wide": '), (F.col("o_orderkey") * 1000000).cast("string"),
        F.lit(', "text": '), F.when(even, number).otherwise(F.concat(F.lit('"t'), number % 10, F.lit('"'))), F.lit("}"),
    )
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("seq"), F.parse_json(text).alias("v"))
    plan, _ = plan_documents(docs, "numbers")
    return spark.createDataFrame([(c.name, c.sql_type) for c in plan.root.columns if c.name != nesting.ROOT_KEY], "name string, sql_type string")


@query("""with o as (select * from orders where o_orderkey % 7 <> 0), i as (select l_orderkey as k, l_linenumber as n from lineitem union all select l_orderkey, l_linenumber from lineitem where l_partkey % 11 = 0)
select (select count(*) from i where k not in (select o_orderkey from o)) as orphans,
  (select count(*) from (select k, n from i group by k, n having count(*) > 1)) as duplicates""")
def key_violations_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Children without a parent row and repeated child keys, on rows that have both."""
    orders = table(spark, sf, "orders").where("o_orderkey % 7 <> 0")
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    items = own.unionAll(own.where("l_partkey % 11 = 0"))
    orphans = without_keys(items, "l_orderkey", orders.select("o_orderkey")).agg(F.count("*").alias("orphans"))
    twice = items.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count("*").alias("duplicates"))
    return orphans.crossJoin(twice)


@query("""select o_orderkey as mongo_id, left(o_orderpriority, 8) as priority, case when o_orderkey % 3 = 0 then o_orderstatus || '2' else o_orderstatus end as status, 2 as runs,
  (select cast(max(o_orderkey) as varchar) from orders) as last_id from orders""")
def load_live_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Tables made in a live catalogue with narrower text, the plan bound to their widths, a load of all documents and one
    of those that changed, and the watermark read back."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    catalog = Catalog(spark, f"live_{uuid.uuid4().hex}")
    plan, _ = plan_documents(S.from_table(rows, "_id"), "orders")
    ensure_tables(catalog, nesting.relax(nesting.bind(plan, {"orders": {"priority": 8, "status": 8}})))
    bound = nesting.bind(nesting.relax(plan), {"orders": catalog.widths("orders")})
    save_watermark(catalog, "orders", load(S.from_table(rows, "_id"), bound, catalog))
    changed = rows.where("_id % 3 = 0").withColumn("status", F.concat("status", F.lit("2")))
    stats = load(S.from_table(changed, "_id"), bound, catalog, mode="incremental")
    runs = 2 if stats.total_rows == changed.count() else 0
    last = load_watermark(catalog, "orders")
    return _kept(catalog, catalog.read("orders").select("mongo_id", "priority", "status", F.lit(runs).alias("runs"), F.lit(str(last)).alias("last_id")))


def _live(spark: SparkSession, docs: DataFrame, collection: str, buckets: int = 8) -> tuple[Catalog, nesting.Plan]:
    """A new schema with the tables of the documents' plan."""
    catalog = Catalog(spark, f"live_{uuid.uuid4().hex}", buckets)
    plan = nesting.relax(plan_documents(docs, collection)[0])
    ensure_tables(catalog, plan)
    return catalog, plan


def _kept(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """rows from a folder of their own; the schema is gone."""
    path = _folder(catalog.spark)
    rows.write.parquet(path)
    catalog.spark.sql(f"DROP SCHEMA `{catalog.schema}` CASCADE")
    return catalog.spark.read.schema(rows.schema).parquet(path)


class _Stop(Exception):
    pass


@query("""select conv_id, cast(row_number() over (partition by conv_id order by turn, role, text) - 1 as integer) as messages_idx, role,
  case when conv_id % 3 = 0 then text || '!' else text end as text, 8 as unchanged, (select cast(max(conv_id) as varchar) from conversations) as last_id from conversations""")
def load_is_atomic(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations and their messages, loaded; then loads of changed ones that fail at each of their 8 steps, after
    which both tables and the watermark are as before; then one that ends."""
    rows = D.conversation_rows(spark, sf)
    docs = S.from_table(rows, "_id")
    catalog, plan = _live(spark, docs, "conversations")
    load(docs, plan, catalog, watermark=True)
    louder = F.transform("messages", lambda m: F.struct(m["turn"], m["role"], F.concat(m["text"], F.lit("!")).alias("text")))
    changed = S.from_table(rows.where("_id % 3 = 0").withColumn("messages", louder), "_id")

    def seen() -> list:
        counts = [catalog.read(t.name).agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first() for t in plan.tables]
        return [*counts, load_watermark(catalog, "conversations")]

    def failing(step: int):
        def progress(done: int, of: int, name: str) -> None:
            if done == step:
                raise _Stop(name)

        return progress

    before, unchanged = seen(), 0
    for step in range(8):
        try:
            load(changed, plan, catalog, watermark=True, progress=failing(step))
        except _Stop:
            unchanged += seen() == before
    load(changed, plan, catalog, watermark=True)
    last = load_watermark(catalog, "conversations")
    messages = catalog.read("conversations_messages")
    return _kept(catalog, messages.select(F.col("conversation_id").cast("long").alias("conv_id"), "messages_idx", "role", "text", F.lit(unchanged).alias("unchanged"), F.lit(str(last)).alias("last_id")))


_TEN = "o_orderkey in (select o_orderkey from orders order by o_orderkey limit 10)"


@query(f"""select o_orderkey, case when {_TEN} then 'new' else o_orderstatus end as status, true as few, (select least(10, count(*)) from orders) as upserted from orders""")
def upsert_few_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Ten orders upserted into a table of 64 buckets: at most ten of its buckets are rewritten, by the names of its
    files."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderstatus").alias("status"))
    catalog, plan = _live(spark, S.from_table(rows, "_id"), "orders", 64)
    load(S.from_table(rows, "_id"), plan, catalog)
    names = lambda: {r[0] for r in catalog.live("orders", catalog.log.latest()[1]).select(F.input_file_name()).distinct().collect()}
    before = names()
    stats = load(S.from_table(rows.orderBy("_id").limit(10).withColumn("status", F.lit("new")), "_id"), plan, catalog)
    few = len(before - names()) <= 10 and len(stats.rewritten["orders"]) <= 10
    return _kept(catalog, catalog.read("orders").select(F.col("mongo_id").cast("long").alias("o_orderkey"), "status", F.lit(few).alias("few"), F.lit(stats.total_rows).cast("long").alias("upserted")))


@query("""select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as n_items from orders where o_orderkey % 3 <> 0""")
def delete_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every third order deleted from a catalogue, with its items, in one commit."""
    docs = D.order_docs(spark, sf)
    catalog, plan = _live(spark, docs, "orders")
    load(docs, plan, catalog)
    catalog.delete_documents(plan, table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey"))
    items = catalog.read("orders_items").groupBy("order_id").agg(F.count("*").alias("n"))
    orders = catalog.read("orders")
    counted = orders.join(items, orders["mongo_id"] == items["order_id"], "full").select(
        F.coalesce("mongo_id", "order_id").cast("long").alias("o_orderkey"), F.when(F.col("mongo_id").isNotNull(), F.coalesce("n", F.lit(0))).cast("long").alias("n_items")
    )
    return _kept(catalog, counted)


@query("""select o_orderkey, o_orderstatus as status, 'incremental' as mode, (select count(*) from orders where o_orderkey > (select max(o_orderkey) // 2 from orders)) as added,
  (select max(o_orderkey) from orders) as mark from orders""")
def load_beyond_mark(spark: SparkSession, sf: str) -> DataFrame:
    """Orders up to half of the largest key, then those beyond the mark that this load has left."""
    from .streaming.incremental import load_new

    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    catalog, plan = _live(spark, S.from_table(rows.withColumnRenamed("o_orderkey", "_id"), "_id"), "orders")
    half = F.lit(rows.agg(F.expr("max(o_orderkey) div 2")).first()[0])
    load_new(rows.where(F.col("o_orderkey") <= half), "o_orderkey", plan, catalog)
    stats = load_new(rows, "o_orderkey", plan, catalog)
    mark = load_watermark(catalog, "orders")
    found = catalog.read("orders").select(F.col("mongo_id").cast("long").alias("o_orderkey"), "status", F.lit(stats.mode).alias("mode"), F.lit(stats.documents).cast("long").alias("added"), F.lit(mark).cast("long").alias("mark"))
    return _kept(catalog, found)


@query("""select o_orderkey, case when o_orderkey % 10 = 7 then 'no key' when o_orderkey % 5 = 0 then 'orders.total is null' else 'loaded' end as outcome,
  (select count(*) from orders) as documents, (select count(*) from orders where o_orderkey % 10 = 7 or o_orderkey % 5 = 0) as rejected from orders""")
def load_sets_misfits_apart(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of which some have no key and some no total, where the plan asks for one: those go to the table of rejects,
    the rest is loaded, and both add up."""
    orders = table(spark, sf, "orders")
    key = F.when(F.col("o_orderkey") % 10 != 7, F.concat(F.lit('"_id": '), F.col("o_orderkey"), F.lit(", "))).otherwise("")
    total = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit('"total": '), F.col("o_custkey"), F.lit(", "))).otherwise("")
    text = F.concat(F.lit("{"), key, total, F.lit('"number": '), F.col("o_orderkey"), F.lit("}"))
    docs = orders.select(F.col("o_orderkey").cast("long").alias("seq"), F.parse_json(text).alias("v"))
    whole = docs.where("seq % 10 <> 7 and seq % 5 <> 0")
    catalog = Catalog(spark, f"live_{uuid.uuid4().hex}", 8)
    plan, _ = plan_documents(whole, "orders")
    ensure_tables(catalog, plan)
    stats = load(docs, plan, catalog, quarantine=True)
    number = F.try_variant_get(F.parse_json("document"), "$.number", "bigint")
    loaded = catalog.read("orders").select(F.col("number").cast("long").alias("o_orderkey"), F.lit("loaded").alias("outcome"))
    rejected = catalog.read(REJECTS).select(number.alias("o_orderkey"), F.col("reason").alias("outcome"))
    found = loaded.unionAll(rejected).select("*", F.lit(stats.documents).cast("long").alias("documents"), F.lit(stats.rejected).cast("long").alias("rejected"))
    return _kept(catalog, found)
