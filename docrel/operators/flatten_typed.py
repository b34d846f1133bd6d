"""A plan applied to typed rows: projections and posexplode on struct fields, no VARIANT on the way.

Same tables as ``flatten``. A null field is a missing one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip_utf16, utf16_len
from ..functions.variants import width_of
from ..plans.nesting import ROOT_KEY, Plan, PlanTable
from ..plans.render import spark_type


def _reach(value: Column | None, kind: T.DataType, dotted: str) -> tuple[Column, T.DataType]:
    """The field at a dotted path, and its type."""
    for name in filter(None, dotted.split(".")):
        value = F.col(f"`{name}`") if value is None else value[name]
        kind = kind[name].dataType
    return value, kind


def typed(value: Column, kind: T.DataType, declared: str) -> tuple[Column, Column]:
    """The value in the declared type, and whether it was clipped."""
    base = declared.partition("(")[0]
    if base in ("NVARCHAR", "CHAR"):
        text = F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")
        width = width_of(declared)
        if width is None:
            return text, F.lit(False)
        return clip_utf16(text, width), F.coalesce(utf16_len(text) > width, F.lit(False))
    if base == "FLOAT":
        x = value.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(False)
    return value.try_cast(spark_type(declared)), F.lit(False)


def _table(df: DataFrame, lead: list[str], value: Column | None, kind: T.DataType, table: PlanTable, base: str) -> DataFrame:
    out, cut = [F.col(c) for c in lead], []
    for c in table.columns:
        if table.kind == "root" and c.name == ROOT_KEY:
            continue
        x, clipped = typed(*_reach(value, kind, c.path.removeprefix(base).lstrip(".")), c.sql_type)
        out.append(x.alias(c.name))
        cut.append(clipped.cast("int"))
    return df.select(*out, reduce(lambda a, b: a + b, cut, F.lit(0)).alias("__clipped"))


def _unnested(rows: DataFrame, lead: list[str], kind: T.DataType, source: str, indexes: tuple[str, ...]) -> tuple[DataFrame, T.DataType]:
    """One row per element of the array at ``source``: lead, positions, __v; and the element's type."""
    value = None
    for level, index in zip((source + "[]").split("[]")[:-1], indexes, strict=True):
        box, array = _reach(value, kind, level.lstrip("."))
        rows = rows.select(*lead, F.posexplode(box).alias(index, "__v"))
        lead, value, kind = [*lead, index], F.col("__v"), array.elementType
    return rows, kind


def _map_table(keyed: DataFrame, schema: T.StructType, table: PlanTable) -> DataFrame:
    """Key/value rows; of a key that elements of an array repeat the first value wins."""
    array, _, inner = table.source.rpartition("[]")
    if not array:
        box, kind = _reach(None, schema, table.source)
        places = []
    else:
        places = [f"__i{k}" for k in range(array.count("[]") + 1)]
        keyed, kind = _unnested(keyed, ["__key"], schema, array, tuple(places))
        box, kind = _reach(F.col("__v"), kind, inner.lstrip("."))
    entries = keyed.select(F.col("__key").alias(table.parent_key), *places, F.explode(box).alias("__k", "__v"))
    name, long = typed(F.col("__k").cast("string"), T.StringType(), table.map_key.sql_type)
    value, cut = typed(F.col("__v"), kind.valueType, table.map_value.sql_type)
    rows = entries.select(
        table.parent_key, name.alias(table.map_key.name), value.alias(table.map_value.name), (long.cast("int") + cut.cast("int")).alias("__clipped"), *places
    )
    if not places:
        return rows
    first = Window.partitionBy(table.parent_key, table.map_key.name).orderBy(*places)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", *places)


def flatten_typed(df: DataFrame, plan: Plan, key: str = "_id") -> dict[str, DataFrame]:
    """Every table of the plan by name; rows without a key are left out."""
    keyed = df.withColumn("__key", typed(F.col(key), df.schema[key].dataType, plan.key)[0]).where("__key is not null")
    out = {plan.root.name: _table(keyed.withColumn(ROOT_KEY, F.col("__key")), [ROOT_KEY], None, df.schema, plan.root, "")}
    for table in plan.children:
        if table.kind == "map":
            out[table.name] = _map_table(keyed, df.schema, table)
            continue
        rows = keyed.withColumn(table.parent_key, F.col("__key"))
        rows, kind = _unnested(rows, [table.parent_key], df.schema, table.source, table.indexes)
        out[table.name] = _table(rows, [table.parent_key, *table.indexes], F.col("__v"), kind, table, table.source + "[]")
    return out
