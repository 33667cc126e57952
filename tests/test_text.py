import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from rowlens.functions.text import WHITESPACE, as_text, is_blank, json_object, lower_escapes, strip, tokens
from conftest import plan_of

TEXTS = [
    "a", "  pad ", " x　", 'q"uo\\te', "tab\tnl\n", "c\x0b\x0e\x0f\x1a\x1f", "\\u000B", "\\\x0b\x0b",
    "é漢字😀", "", "   ", "/slash", "\x7f\x00z", "in  side", "\x1c\x85edge ", "\\\\u000E",
]


def test_whitespace_is_what_text_methods_strip():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_blank(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string").select(
        "t", strip(F.col("t")).alias("s"), is_blank(F.col("t")).alias("b")
    ).collect()
    for r in rows:
        assert r.s == (r.t.strip() if r.t is not None else None)
        assert r.b == (r.t is None or not r.t.strip())


def python_json(**members):
    return json.dumps(members, ensure_ascii=False)


def test_json_objects(spark):
    rows = spark.createDataFrame([(t, None) for t in TEXTS] + [(',"b":', '{"t":')], "t string, b string")
    both = lower_escapes(json_object({"t": F.col("t"), "b": F.col("b")}))
    for r in rows.select("t", "b", both.alias("j")).collect():
        assert r.j == python_json(t=r.t, b=r.b)
    quoted = rows.select(json_object({'é "q"': F.lit("x")}).alias("j")).first()
    assert quoted.j == json.dumps({'é "q"': "x"}, ensure_ascii=False)
    assert rows.select(json_object({}).alias("j")).first().j == "{}"


def test_number_text(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, -1.5, 1e7, 1.25e7, 123456789.125, 1e15, 1e16, 1.5e16, 1e22, 1e100, 1e-3, 1e-4, 1.5e-4, 1e-5,
              -1.25e-5, 1e-300, float("inf"), -float("inf"), 0.1, 1 / 3, 9999999.5, 2e-3]
    values += [round(rng.uniform(-1e9, 1e9), rng.randint(0, 6)) for _ in range(500)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", as_text(F.col("x"), T.DoubleType()).alias("t"))
    assert [r for r in df.collect() if repr(r.x) != r.t] == []
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(as_text(F.col("x"), T.DoubleType()).alias("t"))
    assert [r.t for r in nan.collect()] == [None, None]


def test_other_kinds(spark):
    df = spark.sql(
        "select true b, 7L n, date'2023-01-02' d, timestamp_ntz'2023-01-02 03:04:05' t, "
        "timestamp_ntz'2023-01-02 03:04:05.12' u, cast(1.50 as decimal(5,2)) m"
    )
    row = df.select([as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(row) == ("True", "7", "2023-01-02", "2023-01-02 03:04:05", "2023-01-02 03:04:05.120000", "1.50")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_json_and_strip_of_any_text(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] or [""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", lower_escapes(json_object({"t": F.col("t"), "b": F.reverse("t")})).alias("j"), strip(F.col("t")).alias("s")
    ).collect()
    for r in rows:
        assert json.loads(r.j)["t"] == r.t and r.j == python_json(t=r.t, b=json.loads(r.j)["b"])
        assert r.s == r.t.strip()


def test_tokens(spark):
    row = spark.createDataFrame([("Hello, WORLD! état-x 42_7",)], "t string").select(tokens(F.col("t")).alias("k")).first()
    assert row.k == ["hello", "world", "état", "x", "42", "7"]


def test_text_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, x double").select(
        json_object({"t": strip(F.col("t"))}), as_text(F.col("x"), T.DoubleType())
    )
    assert "Python" not in plan_of(df)
