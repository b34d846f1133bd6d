import pytest
from pyspark.sql import functions as F

from docrel.functions import text as X
from docrel.functions import variants as V
from docrel.plans import infer, nesting


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "units"), [("h\U0001f600i", 4), ("", 0), ("abc", 3)])
def test_utf16_length(spark, text, units):
    assert one(spark, text, X.utf16_len(F.col("x"))) == units


@pytest.mark.parametrize(("text", "units", "out"), [("h\U0001f600ib", 3, "h\U0001f600"), ("h\U0001f600ib", 2, "h"), ("abc", 2, "ab"), ("abc", 9, "abc"), (None, 3, None)])
def test_clip_never_splits_a_pair(spark, text, units, out):
    assert one(spark, text, X.clip_utf16(F.col("x"), units)) == out


@pytest.mark.parametrize(("text", "out"), [("a \U0001f600 b", "a b"), ("a  b", "a  b"), ("✔ ok", "✔ ok"), ("\U0001f600", "")])
def test_strip_emoji(spark, text, out):
    assert one(spark, text, X.strip_emoji(F.col("x"))) == out


@pytest.mark.parametrize(("raw", "out"), [("__v", "__v"), ("a-b c__", "a_b_c"), ("1x", "c_1x"), ("", "col"), ("___", "col"), ("şehir", "_ehir")])
def test_identifiers_agree_on_driver_and_in_columns(spark, raw, out):
    assert nesting.identifier(raw) == out
    assert one(spark, raw, X.identifier(F.col("x"))) == out


@pytest.mark.parametrize(("units", "out"), [(0, 16), (10, 16), (11, 32), (300, 450), (301, 1000), (2666, 4000), (2667, "MAX")])
def test_text_types(spark, units, out):
    assert infer.text_type(units) == f"NVARCHAR({out})"
    assert spark.range(1).select(X.text_type(F.lit(units)).alias("y")).first()["y"] == f"NVARCHAR({out})"


def test_names():
    assert [nesting.parent_key(c) for c in ("conversations", "s", "data")] == ["conversation_id", "col_id", "data_id"]
    assert nesting.column_name("_id", "") == "mongo_id"
    assert nesting.column_name("a.b", "") == "a_b"
    assert nesting.column_name("items[]", "items[]") == "value"
    assert nesting.column_name("items[]._id", "items[]") == "_id"
    assert nesting.index_columns("items[].tags[]") == ["items_idx", "tags_idx"]
    assert nesting.index_columns("a[][]") == ["a_idx", "a_x_idx"]


def stats(**types):
    return infer.PathStats("p", "", sum(types.values()), types.get("null", 0), types, "x")


@pytest.mark.parametrize(
    ("types", "out"),
    [
        ({"int": 1, "int64": 1}, "BIGINT"),
        ({"int": 1, "double": 1}, "FLOAT"),
        ({"int": 1, "decimal": 1}, "FLOAT"),
        ({"int": 1, "string": 1}, "NVARCHAR(128)"),
        ({"null": 2}, "NVARCHAR(16)"),
        ({"bool": 1}, "BIT"),
        ({"objectId": 1}, "CHAR(24)"),
        ({"Regex": 1}, "NVARCHAR(128)"),
    ],
)
def test_declared_types(types, out):
    assert infer.declared_type(stats(**types))[0] == out


LABELS = {
    "null": "null",
    "true": "bool",
    "1": "int",
    "12345678901234567890": "int",
    "1.0": "double",
    "1e3": "double",
    '"x"': "string",
    '{"$oid": "5f"}': "objectId",
    '{"$numberLong": "5"}': "int64",
    '{"$numberDecimal": "1.5"}': "decimal",
    '{"$date": "2020-01-01T00:00:00Z"}': "date",
    '{"$binary": {"base64": "AQI=", "subType": "00"}}': "binary",
    '{"$regex": "a"}': "regex",
    "{}": "object",
    "[]": "array",
}


def test_labels(spark):
    rows = spark.createDataFrame([(k,) for k in LABELS], "x string").select("x", V.label(F.parse_json("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == LABELS


COERCED = [
    ("BIT", "true", True), ("BIT", "2", True), ("BIT", "0", False), ("BIT", '" Yes "', True), ("BIT", '"no"', False), ("BIT", "{}", None),
    ("INT", "1.9", 1), ("INT", "-1.9", -1), ("INT", "true", 1), ("INT", '{"$numberDouble": "NaN"}', None), ("INT", '"12"', None), ("INT", "3000000000", None),
    ("BIGINT", "3000000000", 3000000000), ("BIGINT", '{"$numberLong": "9007199254740993"}', 9007199254740993), ("BIGINT", '{"$numberDecimal": "-2.7"}', -2),
    ("FLOAT", "1", 1.0), ("FLOAT", '{"$numberDouble": "Infinity"}', None), ("FLOAT", '"1.5"', None), ("FLOAT", "true", 1.0),
    ("DECIMAL(38, 6)", '"1.25"', "1.250000"), ("DECIMAL(38, 6)", '"x"', None), ("DECIMAL(38, 6)", "true", None),
    ("DATETIME2(3)", '{"$date": "2020-01-01T02:00:00+02:00"}', "2020-01-01 00:00:00"), ("DATETIME2(3)", '"2020-01-01"', None),
    ("NVARCHAR(3)", '"abcd"', "abc"), ("NVARCHAR(3)", "true", "tru"), ("NVARCHAR(3)", "12", "12"), ("NVARCHAR(MAX)", '{"a":[1]}', '{"a":[1]}'), ("CHAR(24)", '{"$oid": "5f"}', "5f"),
]


@pytest.mark.parametrize("kind", sorted({k for k, _, _ in COERCED}))
def test_coercion(spark, kind):
    cases = [(j, v) for k, j, v in COERCED if k == kind]
    rows = spark.createDataFrame([(j,) for j, _ in cases], "x string").select("x", V.coerce(F.parse_json("x"), kind)[0].alias("y")).collect()
    as_said = lambda v: str(v) if v is not None and kind[:3] in ("DEC", "DAT") else v
    assert [(r["x"], as_said(r["y"])) for r in rows] == cases


def test_clipping_is_reported(spark):
    text, cut = V.coerce(F.parse_json("x"), "NVARCHAR(3)")
    rows = spark.createDataFrame([('"abcd"',), ("12",)], "x string").select(cut.alias("y")).collect()
    assert [r["y"] for r in rows] == [True, False]
