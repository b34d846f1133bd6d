"""What a VARIANT value is, what it holds, and its coercion to a declared type.

Extended-JSON wrappers ({"$oid": ...}, {"$numberLong": ...}, ...) count as the scalar they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clip_utf16, utf16_len

#: Wrapper names and the types they stand for.
WRAPPERS = {
    "oid": "objectId",
    "numberLong": "int64",
    "numberInt": "int",
    "numberDouble": "double",
    "numberDecimal": "decimal",
    "date": "date",
    "binary": "binary",
}
#: First word of a VARIANT's schema and the type it stands for.
SHAPES = {
    "OBJECT": "object",
    "ARRAY": "array",
    "BIGINT": "int",
    "STRING": "string",
    "DOUBLE": "double",
    "FLOAT": "double",
    "BOOLEAN": "bool",
    "VOID": "null",
    "DATE": "date",
    "TIMESTAMP": "date",
    "TIMESTAMP_NTZ": "date",
    "BINARY": "binary",
    "DECIMAL": "double",
}
#: Texts that count as true.
TRUE_TEXTS = ("1", "true", "yes", "y")


def _inner(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f'$["${name}"]', kind)


def label(v: Column, shape: Column | None = None) -> Column:
    """null, bool, int, int64, double, decimal, string, date, objectId, binary, object, array, or a wrapper's name.

    shape: schema_of_variant(v), where a column already holds it."""
    shape = F.schema_of_variant(v) if shape is None else shape
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    # A literal with decimals is an exact DECIMAL to Spark; only whole numbers too large for 64 bits are integers.
    large = F.rlike(shape, F.lit(r"^DECIMAL\((2[0-9]|3[0-9]),0\)"))
    # A wrapper has no other key than its own, and in it a single value or a flat object or array.
    wrapper = F.regexp_extract(shape, r"^OBJECT<`\$(\w+)`: (?:[A-Z_ ]+(?:\(\d+,\d+\))?|[A-Z]+<[^<>]*>)>$", 1)
    # The shape stands here as seldom as can be: where it isn't a column, each place computes it and adds to the code.
    return (
        F.when(v.isNull(), "null")
        .when(shape.startswith("OBJECT<`$"), F.coalesce(F.try_element_at(table(WRAPPERS | {"": "object"}), wrapper), wrapper))
        .when(shape.startswith("DECIMAL"), F.when(large, "int").otherwise("double"))
        .otherwise(F.try_element_at(table(SHAPES), F.substring_index(F.substring_index(shape, "<", 1), "(", 1)))
    )


def text_value(v: Column, kind: Column) -> Column:
    return F.when(kind == "string", F.try_variant_get(v, "$", "string"))


def number_value(v: Column, kind: Column) -> Column:
    """As a double; may be infinite or NaN."""
    wrapped = F.coalesce(*[_inner(v, n) for n in ("numberLong", "numberInt", "numberDouble", "numberDecimal")]).try_cast("double")
    number = kind.isin("int", "int64", "double", "decimal")
    return F.when(number, F.coalesce(F.try_variant_get(v, "$", "double"), wrapped))


def array_length(v: Column, kind: Column) -> Column:
    return F.when(kind == "array", F.size(F.try_variant_get(v, "$", "array<variant>")).cast("long"))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _whole(v: Column, kind: Column | None = None) -> Column:
    """An integer: exact from integer values, towards zero from others; null beyond 64 bits."""
    kind = label(v) if kind is None else kind
    exact = F.coalesce(F.try_variant_get(v, "$", "bigint"), _inner(v, "numberLong").try_cast("bigint"), _inner(v, "numberInt").try_cast("bigint"))
    from_decimal = _inner(v, "numberDecimal").try_cast("decimal(38,6)")
    cut = F.when(from_decimal >= 0, F.floor(from_decimal)).otherwise(F.ceil(from_decimal)).try_cast("bigint")
    x = _finite(number_value(v, kind))
    inside = F.when(F.abs(x) < 2.0**63, x).cast("bigint")
    return (
        F.when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when(kind.isin("int", "int64"), exact)
        .when(kind == "double", inside)
        .when(kind == "decimal", cut)
    )


def as_bit(v: Column, kind: Column | None = None) -> Column:
    kind = label(v) if kind is None else kind
    return (
        F.when(kind == "bool", F.try_variant_get(v, "$", "boolean"))
        .when(kind.isin("int", "int64", "double"), number_value(v, kind) != 0)
        .when(kind == "string", F.lower(F.regexp_replace(text_value(v, kind), r"^\s+|\s+$", "")).isin(*TRUE_TEXTS))
    )


def as_bigint(v: Column, kind: Column | None = None) -> Column:
    return _whole(v, kind)


def as_int(v: Column, kind: Column | None = None) -> Column:
    """Null beyond 32 bits."""
    return _whole(v, kind).try_cast("int")


def as_float(v: Column, kind: Column | None = None) -> Column:
    kind = label(v) if kind is None else kind
    return F.when(kind == "bool", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(_finite(number_value(v, kind)))


def as_decimal(v: Column, kind: Column | None = None) -> Column:
    kind, to = label(v) if kind is None else kind, "decimal(38,6)"
    wrapped = F.coalesce(*[_inner(v, n) for n in ("numberDecimal", "numberLong", "numberInt", "numberDouble")])
    return (
        F.when(kind == "string", F.trim(text_value(v, kind)).try_cast(to))
        .when(kind.isin("int", "int64", "double", "decimal"), F.coalesce(F.try_variant_get(v, "$", to), wrapped.try_cast(to)))
    )


def as_datetime(v: Column, kind: Column | None = None) -> Column:
    """Naive UTC; only date values."""
    kind = label(v) if kind is None else kind
    millis = F.try_variant_get(v, '$["$date"]["$numberLong"]', "string").try_cast("bigint")
    wrapped = F.coalesce(_inner(v, "date").try_cast("timestamp"), F.timestamp_millis(millis))
    plain = F.coalesce(F.try_variant_get(v, "$", "timestamp"), wrapped)
    return F.when(kind == "date", F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(plain, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS")))


def as_binary(v: Column, kind: Column | None = None) -> Column:
    kind = label(v) if kind is None else kind
    wrapped = F.coalesce(F.try_variant_get(v, '$["$binary"]["base64"]', "string"), _inner(v, "binary"))
    return F.when(kind == "binary", F.coalesce(F.try_variant_get(v, "$", "binary"), F.unbase64(wrapped)))


def as_text(v: Column, kind: Column | None = None) -> Column:
    """Strings as they are, containers as JSON, ids and decimals by their digits, bytes in hexadecimal."""
    kind = label(v) if kind is None else kind
    wrapped = F.coalesce(*[_inner(v, n) for n in ("oid", "numberDecimal", "numberLong", "numberInt", "numberDouble")])
    return (
        F.when(kind == "null", F.lit(None).cast("string"))
        .when(kind.isin("object", "array"), F.to_json(v))
        .when(kind == "binary", F.lower(F.hex(as_binary(v, kind))))
        .when(kind == "date", as_datetime(v, kind).cast("string"))
        .otherwise(F.coalesce(wrapped, F.try_variant_get(v, "$", "string"), F.to_json(v)))
    )


def width_of(sql_type: str) -> int | None:
    inside = sql_type.partition("(")[2].rstrip(")").partition(",")[0].strip()
    return int(inside) if inside.isdigit() else None


def coerce(v: Column, sql_type: str, kind: Column | None = None) -> tuple[Column, Column]:
    """The value in the declared type, and whether it was clipped to fit. kind: label(v), where a column holds it."""
    base = sql_type.partition("(")[0].upper()
    plain = {"BIT": as_bit, "INT": as_int, "BIGINT": as_bigint, "FLOAT": as_float, "DECIMAL": as_decimal, "VARBINARY": as_binary}
    if base in plain or base.startswith("DATETIME"):
        return plain.get(base, as_datetime)(v, kind), F.lit(False)
    text, width = as_text(v, kind), width_of(sql_type)
    if width is None:
        return text, F.lit(False)
    return clip_utf16(text, width), F.coalesce(utf16_len(text) > width, F.lit(False))


def coerce_shaped(v: Column, sql_type: str, shape: Column) -> tuple[Column, Column]:
    """The same as ``coerce``. shape: a column with schema_of_variant(v). Values that are of the declared type already take a
    short way; all others are coerced inside a lambda, so that the generated code stays small enough for the JVM to compile."""
    base, width = sql_type.partition("(")[0].upper(), width_of(sql_type)
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL(")
    whole = F.try_variant_get(v, "$", "bigint")
    plain = {"INT": (shape == "BIGINT", whole.try_cast("int")), "BIGINT": (shape == "BIGINT", whole), "FLOAT": (number, _finite(F.try_variant_get(v, "$", "double")))}
    text = base not in ("BIT", "INT", "BIGINT", "FLOAT", "DECIMAL", "VARBINARY") and not base.startswith("DATETIME")
    if text:
        plain[base] = (shape == "STRING", F.try_variant_get(v, "$", "string"))
    others = F.transform(F.array(v), lambda x: as_text(x) if text else coerce(x, sql_type)[0])[0]
    found = F.when(*plain[base]).when(v.isNotNull(), others) if base in plain else F.when(v.isNotNull(), others)
    if not text or width is None:
        return found, F.lit(False)
    return clip_utf16(found, width), F.coalesce(utf16_len(found) > width, F.lit(False))
