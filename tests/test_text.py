from datetime import datetime

from pyspark.sql import functions as F

from feedspark.functions.text import (PY_WHITESPACE, clean_text, combine_text, normalize_category,
                                      parse_published_at, py_strip)


def test_whitespace_table_is_python_isspace():
    assert PY_WHITESPACE == "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def test_py_strip_matches_python(spark):
    vals = [ws + "a b" + ws for ws in PY_WHITESPACE] + ["​ x ​", "", "  "]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(py_strip("s")).collect()]
    assert got == [v.strip() for v in vals]


def test_combine_text_fixture_rows(spark):
    rows = [(" A ", "NaN", "b"), (None, "none", "  "), ("A.", "B", None), ("\tA\n", None, None)]
    df = spark.createDataFrame(rows, "title string, description string, content string")
    got = [r[0] for r in df.select(combine_text("title", "description", "content")).collect()]
    assert got == ["A. b", "", "A.. B", "A"]


def test_clean_text_and_category(spark):
    df = spark.createDataFrame([(" News ",), (None,), ("\tSPORTS\n",)], "c string")
    assert [r[0] for r in df.select(clean_text("c")).collect()] == ["news", "", "sports"]
    assert [r[0] for r in df.select(normalize_category("c")).collect()] == ["news", None, "sports"]


def test_parse_published_at(spark):
    vals = ["2023-10-30 10:12:35", "2023-10-30 10:12:35.123456", "2023-10-30T10:12:35Z", "2023-10-31",
            "garbage", "not-a-date", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_published_at("s")).collect()]
    assert got[:4] == [datetime(2023, 10, 30, 10, 12, 35), datetime(2023, 10, 30, 10, 12, 35, 123456),
                       datetime(2023, 10, 30, 10, 12, 35), datetime(2023, 10, 31)]
    assert got[4:] == [None, None, None]
