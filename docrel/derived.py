"""Document collections built from the flat test tables: nested orders and customers, key/value slots, mixed types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.documents import from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, items): each order's lines in a settled order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    sorted_lines = F.array_sort(F.collect_list(line))
    item = lambda x: F.struct(x["l_partkey"].alias("part"), x["l_suppkey"].alias("supp"), x["l_quantity"].alias("qty"), x["l_extendedprice"].alias("price"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(sorted_lines, item).alias("items"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id, status, customer {name, segment, nation {name, region}}, items [{part, supp, qty, price}]; no lines: []."""
    customer = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    nation = F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("_id"),
        F.col("o_orderstatus").alias("status"),
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), nation.alias("nation")).alias("customer"),
        F.coalesce("items", F.array()).alias("items"),
    )


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(order_rows(spark, sf_dir), "_id")


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id, name, orders [{key, total, lines [{part, supp, qty, price}]}]."""
    orders = table(spark, sf_dir, "orders").join(_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), F.coalesce("items", F.array()).alias("lines"))
    per = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(order), lambda a, b: F.signum(a["key"] - b["key"]).cast("int")).alias("orders"))
    joined = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.coalesce("orders", F.array()).alias("orders"))


def slot_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id, slots {s<supplier>: quantity}: an object whose keys are data."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    entries = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("l_suppkey")).alias("k"), F.col("q").cast("long").alias("v"))))
    return from_table(per.groupBy("l_orderkey").agg(F.map_from_entries(entries).alias("slots")).select(F.col("l_orderkey").alias("_id"), "slots"), "_id")


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id (missing where event_id ends in 7), mix (an int, double, string, object or null by event type), note (only
    for every third user)."""
    e = table(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    mix = (
        F.when(F.col("event_type") == "signup", text(F.col("event_id")))
        .when(F.col("event_type") == "purchase", F.concat(text(F.col("event_id")), F.lit(".5")))
        .when(F.col("event_type") == "error", F.concat(F.lit('"Yes '), text(F.col("user_id") % 100), F.lit('"')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"k": '), text(F.col("user_id")), F.lit("}")))
        .otherwise("null")
    )
    key = F.when(F.col("event_id") % 10 != 7, F.concat(F.lit('"_id": '), text(F.col("event_id")), F.lit(", "))).otherwise("")
    note = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(', "note": "n'), text(F.col("user_id") % 60), F.lit('"'))).otherwise("")
    whole = F.concat(F.lit("{"), key, F.lit('"mix": '), mix, note, F.lit("}"))
    return e.select(F.col("event_id").alias("seq"), F.parse_json(whole).alias("v"))


def prop_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.try_parse_json("props").alias("v"))


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_id, messages [{turn, role, text}] in the order of turns."""
    turn = F.struct("turn", "role", "text")
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_id")).agg(F.array_sort(F.collect_list(turn)).alias("messages"))
