"""Path facts: one row per field occurrence of every document.

Two ways to the same rows. Collections of few shapes (``MAX_SHAPES``) have few paths, known before any document is opened:
each is looked up in its document or array element. All others are walked: a row of facts carries the container that it
stands for until the next level opens it, so each document is walked by one task from root to leaves and nothing is kept
between levels.
Columns: seq, ord (places on the way from the root: positions of array elements, and of keys among those of the document
or, where paths are known, of the collection; their order is reading order), path, parent (container prefix; null for
array elements), type, s (text), x (number), n (array length).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.variants import array_length, label, number_value, text_value
from .sketches import few_values, held_values

#: Beyond these documents are walked: shapes of a collection, characters of a shape, paths of all shapes.
MAX_SHAPES, SHAPE_CHARS, KNOWN_PATHS = 100, 2000, 200


def _facts(level: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    v, kind = F.col("value"), F.col("type")
    return level.select(
        *by, "seq", "ord", "path", "parent", "type", text_value(v, kind).alias("s"), number_value(v, kind).alias("x"), array_length(v, kind).alias("n")
    )


def depth(brackets: Column) -> Column:
    """Levels of the brackets of a document's shape."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, bracket: Column) -> Column:
        now = at["now"] + F.when(bracket == "<", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(brackets, F.lit("[<>]"), F.lit(0)), start, step, lambda at: at["most"])


def deepest(docs: DataFrame) -> int:
    """Levels of the deepest document; documents of a kind share their brackets, which are counted once."""
    brackets = F.regexp_replace(F.regexp_replace(F.schema_of_variant("v"), "`[^`]*`", ""), "[^<>]", "")
    return docs.select(brackets.alias("brackets")).distinct().agg(F.max(depth(F.col("brackets")))).first()[0] or 0


@dataclass
class Node:
    """What lies at a path in any shape: fields of objects, elements of arrays."""

    fields: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None

    def add(self, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                self.fields.setdefault(f.name, Node()).add(f.dataType)
        elif isinstance(kind, T.ArrayType):
            self.items = self.items or Node()
            self.items.add(kind.elementType)

    def below(self) -> list[Node]:
        return [*self.fields.values(), *([self.items] if self.items else [])]

    def levels(self) -> int:
        return max((1 + x.levels() for x in self.below()), default=0)

    def paths(self) -> int:
        return sum(1 + x.paths() for x in self.below())


def tree_of(shapes: list[str]) -> Node | None:
    """The paths of all shapes; none where they don't tell them: elements of several kinds (VARIANT), extended-JSON
    wrappers, keys that no path can name, or too many of them."""
    root = Node()
    for shape in shapes:
        names = [n[1:-1].replace("``", "`") for n in re.findall(r"`(?:[^`]|``)*`", shape)]
        if any(n[:1] == "$" or set("'\"\\") & set(n) for n in names):
            return None
        ddl = re.sub(r"`(?:[^`]|``)*`|\bOBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], shape)
        if re.search(r"\bVARIANT\b", re.sub(r"`(?:[^`]|``)*`", "", ddl)):
            return None
        try:
            root.add(T.DataType.fromDDL(ddl))
        except ParseException:
            return None
    # A document that is an array or a value has no facts.
    root.items = None
    return root if root.paths() <= KNOWN_PATHS else None


def surveyed(docs: DataFrame) -> tuple[DataFrame, Node | None]:
    """docs over all cores, where they lie in fewer partitions than there are cores (other inputs stay where they are), and
    the paths of their shapes, where they have few; both from one pass."""
    shape = F.col("shape")
    plain = F.when(shape.contains("`"), shape).otherwise(F.regexp_replace(shape, r"DECIMAL\(\d+,\d+\)", "DOUBLE"))
    found = docs.select(F.schema_of_variant("v").alias("shape"), F.spark_partition_id().alias("part")).withColumn("shape", plain)
    found = found.withColumn("shape", F.when(F.length("shape") > SHAPE_CHARS, "VARIANT").otherwise(F.col("shape")))
    found = found.agg(F.max("part").alias("part"), held_values(shape, MAX_SHAPES).alias("held"), F.approx_count_distinct(shape).alias("about"))
    part, shapes = found.select("part", few_values(F.col("held"), F.col("about"), MAX_SHAPES)).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    spread = docs.repartition(cores, "seq") if part is not None and part + 1 < cores else docs
    return spread, None if shapes is None else tree_of(shapes)


def _known(docs: DataFrame, tree: Node, by: tuple[str, ...]) -> DataFrame:
    """Facts of documents whose paths are known: those of the root's fields, then those of each array's elements."""
    out = []

    def frame(rows: DataFrame, node: Node, path: str, element: bool) -> None:
        value = F.col("value")
        # Way from the frame's value, path, parent, places, node.
        found: list[tuple[str, str, str | None, list[int], Node]] = [("", path, None, [], node)] if element else []

        def fields(node: Node, way: str, base: str, places: list[int]) -> None:
            for k, name in enumerate(sorted(node.fields, key=lambda n: n.encode("utf-16-be"))):
                at = (f'{way}["{name}"]', base + name, base, [*places, k], node.fields[name])
                found.append(at)
                fields(at[4], at[0], at[1] + ".", at[3])

        fields(node, "", path + "." if path else "", [])
        if found:
            each = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.try_variant_get(value, f"${way}", "variant").alias("value")) for k, (way, *_) in enumerate(found)])
            of = lambda i, kind: F.element_at(F.array(*[F.lit(f[i]).cast(kind) if i < 3 else F.array(*map(F.lit, f[i])).cast(kind) for f in found]), F.col("f.k"))
            there = rows.select(*by, "seq", "ord", F.explode(each).alias("f")).where("f.value is not null")
            out.append(
                there.select(*by, "seq", F.concat("ord", of(3, "array<int>")).alias("ord"), of(1, "string").alias("path"), of(2, "string").alias("parent"), F.col("f.value").alias("value"))
            )
        for way, own, parent, places, node in found:
            # An array directly inside an array is recorded and not entered.
            if node.items and parent is not None:
                items = rows.select(*by, "seq", F.concat("ord", F.array(*map(F.lit, places)).cast("array<int>")).alias("ord"), F.posexplode(F.try_variant_get(value, f"${way}", "array<variant>")).alias("pos", "value"))
                frame(items.select(*by, "seq", F.concat("ord", F.array("pos")).alias("ord"), "value"), node.items, own + "[]", True)

    frame(docs.select(*by, "seq", F.array().cast("array<int>").alias("ord"), F.col("v").alias("value")), tree, "", False)
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionAll(more)
    typed = rows.withColumn("shape", F.schema_of_variant("value")).withColumn("type", label(F.col("value"), F.col("shape")))
    return _facts(typed, by)


def facts(docs: DataFrame, max_depth: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """by: columns of docs that every fact keeps. Documents deeper than ``max_depth`` levels are an error, as their facts
    would be incomplete."""
    docs, tree = surveyed(docs.select(*by, "seq", "v"))
    levels = deepest(docs) if tree is None else tree.levels()
    if levels > max_depth:
        raise ValueError(f"documents are deeper than {max_depth} levels")
    return _known(docs, tree, by) if tree is not None and tree.fields else _walked(docs, levels, by)


def _walked(docs: DataFrame, levels: int, by: tuple[str, ...]) -> DataFrame:
    none = F.array().cast("array<struct<pos: int, key: string, value: variant>>")
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    fields = F.transform(F.map_entries(F.try_variant_get("value", "$", "map<string, variant>")), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("key"), e["value"].alias("value")))
    items = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda e, i: F.struct(i.alias("pos"), F.lit(None).cast("string").alias("key"), e.alias("value")))
    inside = F.when(F.col("open") & (F.col("type") == "object"), fields).when(F.col("open") & (F.col("type") == "array"), items).otherwise(none)
    rows = docs.where(label(F.col("v")) == "object").select(
        *by, "seq", F.array().cast("array<int>").alias("ord"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"),
        F.col("v").alias("value"), F.lit("object").alias("type"), F.lit("").alias("base"), F.lit(True).alias("open"), F.lit(False).alias("is_fact"),
    )
    for _ in range(levels):
        rows = rows.select("*", F.explode(F.concat(F.when(F.col("is_fact"), itself).otherwise(none), inside)).alias("k"))
        own, in_array = F.col("k.pos") < 0, F.col("type") == "array"
        old = lambda name, new: F.when(own, F.col(name)).otherwise(new).alias(name)
        rows = rows.select(
            *by,
            "seq",
            old("ord", F.concat("ord", F.array("k.pos"))),
            old("path", F.concat("base", F.when(in_array, "").otherwise(F.col("k.key")))),
            old("parent", F.when(~in_array, F.col("base"))),
            old("value", F.col("k.value")),
            F.when(own, F.col("type")).alias("known"),
            F.when(~own, F.schema_of_variant("k.value")).alias("shape"),
        )
        rows = rows.withColumn("type", F.coalesce("known", label(F.col("value"), F.col("shape"))))
        # An array directly inside an array is recorded and not entered.
        enter = F.col("known").isNull() & ((F.col("type") == "object") | ((F.col("type") == "array") & F.col("parent").isNotNull()))
        base = F.concat("path", F.when(F.col("type") == "array", "[]").otherwise("."))
        rows = rows.select(*by, "seq", "ord", "path", "parent", "value", "type", base.alias("base"), enter.alias("open"), F.lit(True).alias("is_fact"))
    return _facts(rows.where("is_fact"), by)


def first_paths(found: DataFrame, max_paths: int) -> DataFrame:
    """(path): the first ``max_paths`` paths in reading order, without those inside a path that is left out."""
    seen = found.groupBy("path").agg(F.min(F.struct("seq", "ord")).alias("first"))
    return seen.orderBy("first").limit(max_paths).select("path")
