"""The profile of a collection: one row per field path.

Columns: path, parent, present, nulls, types (map of type to count), dominant, max_utf16, longest, num_min, num_max,
non_integral, non_finite, array_max, array_total, distinct_values (null where more than the limit), first (order of
the path's first occurrence).

``profile_facts`` aggregates path facts in two levels, by path and type and then by path; facts are read once and texts
never shuffle. ``profile_typed`` needs no facts: one aggregation per array level, generated from the schema. Distinct
values are held in the same aggregations, in sketches that are exact up to several times the limit and stop growing
beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import utf16_len
from .sketches import few_values, held_values

PREVIEW, DISTINCT, DISTINCT_CHARS, MAX_PATHS = 80, 50, 200, 4000
#: Rows of path names that may go to every task.
FEW = 10_000


def profile_paths(found: DataFrame, preview: int = PREVIEW, distinct: int = DISTINCT, by: tuple[str, ...] = ()) -> DataFrame:
    """All paths (of each value of ``by``), however many; first: seq and positions of their first occurrence."""
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    found = found.withColumn("units", utf16_len(F.col("s")))
    units = F.col("units")
    by_type = found.groupBy(*by, "path", "type").agg(
        F.first("parent", ignorenulls=True).alias("parent"),
        F.count("*").alias("n"),
        F.min(F.struct("seq", "ord")).alias("first"),
        F.max(units).alias("units"),
        F.min_by(F.struct(units.alias("u"), F.left("s", F.lit(preview)).alias("t")), F.when(units.isNotNull(), F.struct((-units).alias("u"), "seq", "ord"))).alias("long"),
        F.min(F.when(finite, F.col("x"))).alias("lo"),
        F.max(F.when(finite, F.col("x"))).alias("hi"),
        F.max(F.when(F.col("x").isNotNull() & finite & (F.col("type") == "double"), F.col("x") != F.rint("x"))).alias("odd"),
        F.max((F.col("type").isin("int", "int64", "double", "decimal")) & (F.col("x").isNull() | ~finite)).alias("wild"),
        F.max("n").alias("longest_array"),
        F.sum("n").alias("elements"),
        F.approx_count_distinct(F.when(F.length("s") <= DISTINCT_CHARS, F.col("s"))).alias("about"),
        held_values(F.when(F.length("s") <= DISTINCT_CHARS, F.col("s")), distinct).alias("held"),
    )
    concrete = F.col("type") != "null"
    rows = by_type.groupBy(*by, "path").agg(
        F.first("parent", ignorenulls=True).alias("parent"),
        F.sum("n").alias("present"),
        F.coalesce(F.sum(F.when(~concrete, F.col("n"))), F.lit(0)).alias("nulls"),
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "type", "n"))), lambda t: F.struct(t["type"], t["n"]))).alias("types"),
        F.coalesce(F.max_by(F.when(concrete, F.col("type")), F.when(concrete, F.struct("n", (-F.col("first.seq")).alias("a"), F.transform("first.ord", lambda o: -o).alias("b")))), F.lit("null")).alias("dominant"),
        F.coalesce(F.max("units"), F.lit(0)).alias("max_utf16"),
        F.coalesce(F.max_by("long.t", "long.u"), F.lit("")).alias("longest"),
        F.min("lo").alias("num_min"),
        F.max("hi").alias("num_max"),
        F.coalesce(F.max("odd"), F.lit(False)).alias("non_integral"),
        F.coalesce(F.max("wild"), F.lit(False)).alias("non_finite"),
        F.coalesce(F.max("longest_array"), F.lit(0)).alias("array_max"),
        F.coalesce(F.sum("elements"), F.lit(0)).alias("array_total"),
        F.min("first").alias("first"),
        F.max("about").alias("about"),
        F.first(F.when(F.col("type") == "string", F.col("held")), ignorenulls=True).alias("held"),
    )
    return rows.withColumn("distinct_values", few_values(F.col("held"), F.col("about"), distinct)).drop("about", "held")


def first_rows(paths: DataFrame, max_paths: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``max_paths`` paths (of each value of ``by``) in reading order, numbered."""
    if by:
        number = F.row_number().over(Window.partitionBy(*by).orderBy("first")).cast("long")
        return paths.withColumn("first", number).where(F.col("first") <= max_paths)
    # No more rows than that are left to number.
    return paths.orderBy("first").limit(max_paths).withColumn("first", F.row_number().over(Window.orderBy("first")).cast("long"))


def profile_facts(found: DataFrame, preview: int = PREVIEW, distinct: int = DISTINCT, max_paths: int = MAX_PATHS) -> DataFrame:
    return first_rows(profile_paths(found, preview, distinct), max_paths)


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.LongType):
        return "int64"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, T.StructType):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    return "null" if isinstance(kind, T.NullType) else kind.simpleString()


def _measures(path: str, parent: str | None, value: Column, there: Column, kind: T.DataType, order: Column, at: int, preview: int, distinct: int) -> Column:
    name, lit = _type_name(kind), F.lit
    null = lit(None).cast("double")
    is_text, is_number, is_array = name == "string", name in ("int", "int64", "double", "decimal"), name == "array"
    x = value.cast("double") if is_number else null
    finite = F.when(there & ~F.isnan(x) & (F.abs(x) < float("inf")), x) if is_number else null
    held = there & value.isNotNull()
    units = F.when(held, utf16_len(value)) if is_text else lit(None).cast("long")
    size = F.when(held, F.size(value)).cast("long") if is_array else lit(None).cast("long")
    count = lambda c: F.coalesce(F.count_if(c), lit(0))
    no = lit(False)
    short = F.when(held & (F.length(value) <= DISTINCT_CHARS), value.cast("string")) if is_text else None
    n = count(held)
    null_n = count(there & value.isNull())
    types = F.map_filter(F.map_from_arrays(F.array(lit(name), lit("null")), F.array(n, null_n)), lambda _, c: c > 0) if name != "null" else F.create_map(lit("null"), null_n)
    return F.struct(
        lit(path).alias("path"),
        lit(parent).cast("string").alias("parent"),
        count(there).alias("present"),
        null_n.alias("nulls"),
        types.alias("types"),
        F.when(n > 0, lit(name)).otherwise("null").alias("dominant"),
        (F.coalesce(F.max(units), lit(0)) if is_text else lit(0)).cast("long").alias("max_utf16"),
        (F.coalesce(F.max_by(F.left(value, lit(preview)), F.struct(units, order)), lit("")) if is_text else lit("")).alias("longest"),
        (F.min(finite) if is_number else null).alias("num_min"),
        (F.max(finite) if is_number else null).alias("num_max"),
        (F.coalesce(F.max(finite != F.rint(finite)), no) if name == "double" else no).alias("non_integral"),
        (F.coalesce(F.max(held & finite.isNull()), no) if name == "double" else no).alias("non_finite"),
        (F.coalesce(F.max(size), lit(0)) if is_array else lit(0)).cast("long").alias("array_max"),
        (F.coalesce(F.sum(size), lit(0)) if is_array else lit(0)).cast("long").alias("array_total"),
        lit(at).cast("long").alias("first"),
        (F.approx_count_distinct(short) if is_text else lit(0)).cast("long").alias("about"),
        (held_values(short, distinct) if is_text else lit(None).cast("array<struct<item: string, count: bigint>>")).alias("held"),
    )


def profile_typed(df: DataFrame, key: str, preview: int = PREVIEW, distinct: int = DISTINCT) -> DataFrame:
    """Profile of typed rows; ``key`` gives reading order. Fields of absent objects are missing, others null."""
    frames: list[tuple[DataFrame, list, list]] = []
    at = 0

    def fields(kind: T.StructType, base: str, value, there: Column, out: list, arrays: list) -> None:
        nonlocal at
        for f in kind.fields:
            col = F.col(f"`{f.name}`") if value is None else value[f.name]
            at += 1
            out.append((base + f.name, base, col, there, f.dataType, at))
            if isinstance(f.dataType, T.StructType):
                fields(f.dataType, base + f.name + ".", col, there & col.isNotNull(), out, arrays)
            elif isinstance(f.dataType, T.ArrayType):
                at += 1
                arrays.append((base + f.name + "[]", col, f.dataType.elementType, at))

    def frame(data: DataFrame, kind: T.DataType, base: str, value, number: int) -> None:
        out, arrays = [], []
        if value is not None:
            out.append((base, None, value, F.lit(True), kind, number))
        if isinstance(kind, T.StructType):
            fields(kind, base + "." if base else "", value, F.lit(True) if value is None else value.isNotNull(), out, arrays)
        frames.append((data, out, arrays))
        for path, col, element, k in arrays:
            items = data.select("__key", "__ord", F.posexplode(col).alias("__pos", "__v")).select(
                "__key", F.concat("__ord", F.array(-F.col("__pos"))).alias("__ord"), "__v"
            )
            frame(items, element, path, F.col("__v"), k)

    start = df.withColumns({"__key": -F.col(key).cast("long"), "__ord": F.array().cast("array<int>")})
    frame(start, df.schema, "", None, 0)
    rows = None
    for data, out, _ in frames:
        order = F.struct("__key", "__ord")
        measured = data.agg(*[_measures(p, parent, c, there, kind, order, k, preview, distinct).alias(f"c{i}") for i, (p, parent, c, there, kind, k) in enumerate(out)])
        flat = measured.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(out))])).alias("r")).select("r.*")
        rows = flat if rows is None else rows.unionAll(flat)
    rows = rows.where("present > 0")
    return rows.withColumn("distinct_values", few_values(F.col("held"), F.col("about"), distinct)).drop("about", "held")


def containers(rows: DataFrame, documents, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, parent, visits): how often each container prefix that was entered was. documents: their number, or a table of by and n."""
    objects = rows.select(*by, F.concat("path", F.lit(".")).alias("parent"), F.coalesce(F.element_at("types", "object"), F.lit(0)).alias("visits"))
    roots = documents if by else rows.sparkSession.range(1).select(F.lit(documents).cast("long").alias("n"))
    return objects.where("visits > 0").unionAll(roots.select(*by, F.lit("").alias("parent"), F.col("n").alias("visits")))


def meet(rows: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined with a table that is mostly small and read twice. A small one goes to the rows: dealt out by their
    containers or boxes, all fields of one object would lie in one task."""
    small = few.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(few) if small else few, on, how)


def with_fill(rows: DataFrame, documents, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (read several times) with ``fill``: presence among the visits of the own container; null for array elements."""
    filled = meet(rows, containers(rows, documents, by), [*by, "parent"], "left")
    return filled.withColumn("fill", F.when(F.col("visits") > 0, F.col("present") / F.col("visits"))).drop("visits")


def direct_children(filled: DataFrame) -> DataFrame:
    """Rows that are fields of an object path, with that path as ``owner``."""
    last = F.substring_index("path", ".", -1)
    inside = filled.where((F.col("parent") != "") & ~F.contains(last, F.lit("[]")))
    return inside.withColumn("owner", F.expr("substring(parent, 1, length(parent) - 1)")).withColumn("key", F.expr("substring(path, length(parent) + 1)"))


def above(path: Column) -> Column:
    """The objects and arrays that a path may lie in, by the places of its marks."""
    marks = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(path))), lambda i: F.substr(path, i, F.lit(1)).isin(".", "["))
    return F.transform(marks, lambda i: F.left(path, i - 1))


def outside(rows: DataFrame, boxes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows whose path lies in none of the boxes (by, path)."""
    boxes = boxes.select(*by, F.col("path").alias("box"))
    inside = meet(rows.select(*by, "path", F.explode(above(F.col("path"))).alias("box")), boxes, [*by, "box"], "left_semi")
    return rows.join(inside.select(*by, "path").distinct(), [*by, "path"], "left_anti")


def maps(filled: DataFrame, min_keys: int = 30, max_fill: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """Objects whose keys are data: many direct children, each rarely present. One row per such path; value_types: how
    many values of each type their keys have, all keys together."""
    owner = [*by, "owner"]
    # Summed up by object before any join, so the keys of a large one don't meet in one task.
    kids = direct_children(filled)
    found = kids.groupBy(*owner).agg(
        F.count("*").alias("keys"),
        F.sum("present").alias("present"),
        F.max(utf16_len(F.col("key"))).alias("key_max_utf16"),
        F.max("max_utf16").alias("value_max_utf16"),
    )
    objects = filled.where("dominant = 'object'").select(*by, F.col("path").alias("owner"), F.element_at("types", F.lit("object")).alias("visits"))
    # The mean of present / visits, without the errors that many small fractions add up to.
    fill = F.col("present") / (F.col("keys") * F.col("visits"))
    found = found.where(F.col("keys") >= min_keys).join(objects, owner).withColumn("avg_fill", fill).where(F.col("avg_fill") <= max_fill)
    found = found.select(*owner, "keys", "avg_fill", "key_max_utf16", "value_max_utf16")
    counted = kids.select(*owner, F.explode(F.map_filter("types", lambda t, _: t != "null")).alias("type", "n")).groupBy(*owner, "type").agg(F.sum("n").alias("n"))
    types = counted.groupBy(*owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("value_types"))
    none = F.create_map().cast("map<string, bigint>")
    return found.join(types, owner, "left").withColumn("value_types", F.coalesce("value_types", none)).withColumnRenamed("owner", "path")
