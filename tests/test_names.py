import pytest

from rowlens.functions.names import align_types, clean_columns, clean_name, display_label, union_rows


@pytest.mark.parametrize(
    "header, name",
    [
        ("  Title of  Publication ", "title"),
        ("title_of_publicaion", "title"),
        ("Dept.", "dept"),
        ("Department", "dept"),
        ("Author Name", "author"),
        ("Authors", "author"),
        ("Type", "pub_type"),
        ("Publication Type", "pub_type"),
        ("Pub_Date", "publication_date"),
        ("Date of Publication", "publication_date"),
        ("Year_", "year"),
        ("A \tB__", "a_b"),
        ("_lead", "_lead"),
        ("", ""),
    ],
)
def test_clean_name(header, name):
    assert clean_name(header) == name


def test_aliases_are_a_parameter():
    assert clean_name("Type", {}) == "type"
    assert clean_name("Kind", {"kind": "pub_type"}) == "pub_type"


def test_display_label():
    assert display_label("co-author_name") == "Co-Author Name"


def test_headers_that_meet_are_coalesced_left_to_right(spark):
    df = spark.createDataFrame([(None, "b", 1), ("a", "b", 2), (None, None, 3)], "`Dept.` string, Department string, n int")
    out = clean_columns(df)
    assert out.columns == ["dept", "n"]
    assert [r.dept for r in out.orderBy("n").collect()] == ["b", "a", None]
    with pytest.raises(ValueError):
        clean_columns(df, on_collision="error")


def test_colliding_types_become_text(spark):
    df = spark.createDataFrame([(None, 2), ("x", 3)], "Author string, Authors int")
    assert [r.author for r in clean_columns(df).collect()] == ["2", "x"]


def test_identical_raw_headers(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int").toDF("X", "x ")
    assert [r.x for r in clean_columns(df).collect()] == [1, 2]


def test_union_aligns_types_and_columns(spark):
    a = spark.createDataFrame([(1, "x")], "year int, a string")
    b = spark.createDataFrame([("n/a", 2.5)], "year string, b double")
    c = spark.createDataFrame([(2023,)], "b int")
    out = union_rows([a, b, c])
    assert out.columns == ["year", "a", "b"]
    assert dict(out.dtypes) == {"year": "string", "a": "string", "b": "double"}
    assert {(r.year, r.a, r.b) for r in out.collect()} == {("1", "x", None), ("n/a", None, 2.5), (None, None, 2023.0)}


def test_align_keeps_frames_that_agree(spark):
    a = spark.range(1)
    assert align_types([a, a])[0] is a
