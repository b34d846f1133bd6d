"""A plan applied to documents: one DataFrame per table, from VARIANT documents (seq, v).

Arrays are unnested level by level with their positions, objects with data as keys into key/value rows (the first value
of a key wins). Every table carries ``__clipped``, the number of values cut to fit in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip_utf16, utf16_len
from ..functions.variants import coerce, coerce_shaped, label, width_of
from ..plans.nesting import ROOT_KEY, Plan, PlanTable


def at(v: Column, dotted: str) -> Column:
    """The value at a dotted path, null where a link is missing or not an object."""
    steps = ""
    for key in dotted.split(".") if dotted else []:
        if '"' not in key:
            steps += f'["{key}"]'
        elif "'" not in key:
            steps += f"['{key}']"
        else:  # no path can name it
            v, steps = F.try_element_at(F.try_variant_get(v, f"${steps}", "map<string, variant>"), F.lit(key)), ""
    return F.try_variant_get(v, f"${steps}", "variant")


def with_key(docs: DataFrame, plan: Plan) -> DataFrame:
    """docs with their root key ``__key``, null where they have none. Value, shape and kind are columns of their own, so
    that each is computed, and stands in the generated code, once."""
    own = next((c for c in plan.root.columns if c.name == ROOT_KEY), None)
    found = docs.withColumn("__kv", at(F.col("v"), own.path if own else "_id"))
    found = found.withColumn("__ks", F.schema_of_variant("__kv"))
    found = found.withColumn("__kk", label(F.col("__kv"), F.col("__ks")))
    return found.select(*docs.columns, coerce(F.col("__kv"), plan.key, F.col("__kk"))[0].alias("__key"))


def _keyed(docs: DataFrame, plan: Plan) -> DataFrame:
    """Documents with their key; those without one are left out."""
    there = F.filter(F.array("__key"), lambda k: k.isNotNull())
    # Not a filter, which would be pushed down with all that the key is computed from.
    return with_key(docs, plan).select(*docs.columns, F.explode(there).alias("__key"))


def without_key(docs: DataFrame, plan: Plan) -> DataFrame:
    return with_key(docs, plan).where(F.col("__key").isNull()).drop("__key")


def _projected(df: DataFrame, lead: list[Column], value: Column, table: PlanTable, base: str) -> DataFrame:
    """Values, then their shapes, then typed columns: each is computed once per row."""
    columns = [c for c in table.columns if table.kind != "root" or c.name != ROOT_KEY]
    found = df.select(*lead, *[at(value, c.path.removeprefix(base).lstrip(".")).alias(f"__v{k}") for k, c in enumerate(columns)])
    shaped = found.withColumns({f"__s{k}": F.schema_of_variant(f"__v{k}") for k in range(len(columns))})
    out, clipped = [c for c in found.columns if not c.startswith("__v")], F.lit(0)
    for k, c in enumerate(columns):
        typed, cut = coerce_shaped(F.col(f"__v{k}"), c.sql_type, F.col(f"__s{k}"))
        out.append(typed.alias(c.name))
        clipped = clipped + cut.cast("int")
    return shaped.select(*out, clipped.alias("__clipped"))


def root_rows(docs: DataFrame, plan: Plan) -> DataFrame:
    return _projected(_keyed(docs, plan), [F.col("__key").alias(ROOT_KEY)], F.col("v"), plan.root, "")


def elements(docs: DataFrame, source: str, indexes: tuple[str, ...]) -> DataFrame:
    """One row per element of the array at ``source`` (with [] at each array on the way): __key, positions, __v."""
    levels = (source + "[]").split("[]")[:-1]
    df, value = docs, F.col("v")
    for k, level in enumerate(levels):
        kept = [c for c in df.columns if c in ("__key", "seq") or c in indexes[:k]]
        box = at(value, level.lstrip("."))
        df = df.select(*kept, F.posexplode(F.try_variant_get(box, "$", "array<variant>")).alias(indexes[k], "__v"))
        value = F.col("__v")
    return df


def array_rows(docs: DataFrame, plan: Plan, table: PlanTable) -> DataFrame:
    items = elements(_keyed(docs, plan), table.source, table.indexes)
    lead = [F.col("__key").alias(table.parent_key), *(F.col(i) for i in table.indexes)]
    return _projected(items, lead, F.col("__v"), table, table.source + "[]")


def map_rows(docs: DataFrame, plan: Plan, table: PlanTable) -> DataFrame:
    spark, keyed = docs.sparkSession, _keyed(docs, plan)
    if "[]" in table.source:
        array, _, inner = table.source.rpartition("[]")
        places = tuple(f"__i{k}" for k in range(array.count("[]") + 1))
        boxes = elements(keyed, array, places).withColumn("__box", at(F.col("__v"), inner.lstrip(".")))
    else:
        places = ()
        boxes = keyed.withColumn("__box", at(F.col("v"), table.source))
    boxes = boxes.where(label(F.col("__box")) == "object").select("__key", "seq", *places, "__box")
    entries = boxes.lateralJoin(spark.tvf.variant_explode(F.col("__box").outer()))
    width = width_of(table.map_key.sql_type)
    name = clip_utf16(F.col("key"), width) if width else F.col("key")
    long = F.coalesce(utf16_len(F.col("key")) > width, F.lit(False)) if width else F.lit(False)
    value, cut = coerce(F.col("value"), table.map_value.sql_type)
    rows = entries.select(
        F.col("__key").alias(table.parent_key), name.alias(table.map_key.name), value.alias(table.map_value.name),
        (cut.cast("int") + long.cast("int")).alias("__clipped"), "seq", *places, F.col("pos").alias("__pos"),
    )
    first = Window.partitionBy(table.parent_key, table.map_key.name).orderBy("seq", *places, "__pos")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "seq", "__pos", *places)


def flatten(docs: DataFrame, plan: Plan) -> dict[str, DataFrame]:
    """Every table of the plan by name."""
    out = {plan.root.name: root_rows(docs, plan)}
    for table in plan.children:
        out[table.name] = (map_rows if table.kind == "map" else array_rows)(docs, plan, table)
    return out


def clipped_count(tables: dict[str, DataFrame]) -> int:
    return sum(df.agg(F.coalesce(F.sum("__clipped"), F.lit(0))).first()[0] for df in tables.values())
