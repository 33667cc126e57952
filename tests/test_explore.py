import pytest

from conftest import plan_of
from rowlens.operators.explore import display_strings, preview, profile, search, sheet_counts
from rowlens.operators.profiles import STANDARD_ERROR, StoredProfile

SCHEMA = "a string, b string, n int, x double"
ROWS = [("A.C", "x", 12, 1.5), ("abc", None, None, float("nan")), (None, "ABC nan", 3, -0.0), ("zz", "x", 120, 0.0)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def names(df):
    return sorted((r.a or "") for r in df.collect())


def test_search_is_literal_by_default(df):
    assert names(search(df, "a.c", ["a"])) == ["A.C"]
    assert names(search(df, "a.c", ["a"], regex=True)) == ["A.C", "abc"]
    assert names(search(df, "ABC")) == ["", "abc"]
    assert names(search(df, "12")) == ["A.C", "zz"]


def test_nulls_never_match(df):
    assert names(search(df, "nan")) == [""]
    assert names(search(df, "null")) == []


def test_no_term_means_all_rows(df):
    assert search(df, None) is df and search(df, "") is df


def test_search_stays_in_the_jvm_and_prunes(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    plan = plan_of(search(part, "red", ["p_name"]).select("p_partkey"))
    assert "Python" not in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


@pytest.mark.parametrize("exact", [True, False])
def test_profile(df, exact):
    found = {r["column"]: tuple(r)[1:] for r in profile(df, exact=exact).collect()}
    assert found == {
        "a": ("string", 3, 3, "A.C"),
        "b": ("string", 3, 2, "ABC nan"),
        "n": ("int", 3, 3, "12"),
        "x": ("double", 3, 2, "0.0"),
    }


def test_profile_of_empty_columns_and_long_samples(spark):
    df = spark.createDataFrame([("r", None, "y" * 80)], "row_id string, e string, l string")
    found = {r["column"]: tuple(r)[1:] for r in profile(df).collect()}
    assert found == {"e": ("string", 0, 0, "N/A"), "l": ("string", 1, 1, "y" * 50)}
    none = {r["column"]: r.non_null for r in profile(df.limit(0)).collect()}
    assert none == {"e": 0, "l": 0}


def test_stored_profile_of_a_growing_table(spark, tmp_path):
    stored = StoredProfile(spark, str(tmp_path / "p"))
    assert stored.read().count() == 0
    stored.add(spark.range(0, 20_000).selectExpr("id", "id % 7 as few", "cast(null as string) as none", "'x' as row_id"))
    stored.add(spark.range(10_000, 30_000).selectExpr("id", "cast(id % 7 as string) as few", "id * 0.5D as late"))
    stored.add(spark.range(0).selectExpr("id", "id as few"))
    found = {r["column"]: r for r in stored.read().collect()}
    assert set(found) == {"id", "few", "none", "late"}
    assert found["id"]["non_null"] == 40_000 and found["id"]["type"] == "bigint" and found["id"]["sample"] == "0"
    assert abs(found["id"]["n_distinct"] - 30_000) <= 4 * STANDARD_ERROR * 30_000
    assert tuple(found["few"])[1:] == ("string", 40_000, 7, "0")
    assert tuple(found["none"])[1:] == ("string", 0, 0, "N/A")
    assert found["late"]["non_null"] == 20_000


def test_a_stored_profile_reads_its_sketches_only(spark, tmp_path):
    stored = StoredProfile(spark, str(tmp_path / "p"))
    stored.add(spark.range(100).toDF("n"))
    assert [f.rsplit("/", 2)[1] for f in stored.read().inputFiles()] == ["p"]


def test_display_and_preview(spark, df):
    assert [tuple(r) for r in display_strings(df).collect()][:2] == [("A.C", "x", "12", "1.5"), ("abc", "", "", "")]
    nan = spark.createDataFrame([("nan",)], "a string")
    assert display_strings(nan).first().a == ""
    assert [r.n for r in preview(df, ["n"], 2).collect()] == ["", "3"]
    assert "TakeOrderedAndProject" in plan_of(preview(df, ["n"], 2))


def test_sheet_counts(spark):
    df = spark.createDataFrame([("s",), ("s",), ("t",)], "source_sheet string")
    assert {tuple(r) for r in sheet_counts(df).collect()} == {("s", 2), ("t", 1)}
