import pytest
from pyspark.sql import functions as F

from trussline.functions import numbers as N


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_to_number(spark):
    texts = ["0.3", "0,3", "1e3", " 12 ", "1,234.5", "1,2,3", "", "abc", "Infinity", "1d", None, "1e999", "-.5"]
    assert one(spark, texts, "string", N.to_number) == [0.3, 0.3, 1000.0, 12.0, *[None] * 8, -0.5]


@pytest.mark.parametrize(("locale", "want"), [("it", ["1.234,56", "12", "0,13", "1", ""]), ("en", ["1,234.56", "12", "0.13", "1", ""])])
def test_display(spark, locale, want):
    assert one(spark, [1234.56, 12.0, 0.125, 1.005, float("nan")], "double", lambda c: N.format_number(c, locale=locale)) == want


def test_csv(spark):
    assert one(spark, [1234.56, 12.0, 0.125, 1.005, float("inf")], "double", lambda c: N.csv_number(c, ",")) == ["1234,56", "12", "0,125", "1,005", ""]
    assert one(spark, ["a", "a;b", 'say "x"', "l\nm", None], "string", N.csv_field) == ["a", '"a;b"', '"say ""x"""', '"l\nm"', ""]


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ["A10", "A2", "a1", "9", "10", "b"]], "k string")
    assert [r[0] for r in df.orderBy(N.natural_key(F.col("k"))).collect()] == ["9", "10", "a1", "A2", "A10", "b"]


def test_natural_order_of_long_digit_runs(spark):
    want = ["A9", "A" + "0" * 25 + "10", "A" + "1" * 20 + "2", "A" + "1" * 20 + "3", "A" + "1" * 22, "A2" + "0" * 21]
    df = spark.createDataFrame([(x,) for x in want[::-1]], "k string")
    assert [r[0] for r in df.orderBy(N.natural_key(F.col("k"))).collect()] == want
