from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from claimspark.functions import scalar


def shifted(d, months, days):
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(d.day, last)) + timedelta(days=days)


@pytest.mark.parametrize("span", [(1, 0), (3, 0), (12, 0), (0, 7), (1, 3), (0, 1)])
def test_periods_tile_the_calendar(spark, span):
    anchor = date(2019, 10, 31)
    days = spark.sql("SELECT explode(sequence(date'2018-12-01', date'2021-03-31')) AS d")
    a = F.lit(anchor)
    i = scalar.period_index(a, span, F.col("d"))
    rows = days.select("d", i.alias("i"), scalar.period_start_of(a, span, i).alias("s"), scalar.period_start_of(a, span, i + 1).alias("e")).collect()
    for r in rows:
        n = -60 if span[0] else -1000
        while shifted(anchor, (n + 1) * span[0], (n + 1) * span[1]) <= r.d:
            n += 1
        assert r.i == n and r.s == shifted(anchor, n * span[0], n * span[1]) <= r.d < r.e


def test_rounding_half_away_to_a_multiple(spark):
    values = [Decimal(x) for x in ("2.345", "-2.345", "0.005", "-0.005", "1.10", "7")]
    df = spark.createDataFrame([(v,) for v in values], "x decimal(10,3)")
    got = [r[0] for r in df.select(scalar.round_to(F.col("x"), F.lit(Decimal("0.01")))).collect()]
    assert got == [v.quantize(Decimal("0.01"), ROUND_HALF_UP) for v in values]
    assert df.select(scalar.round_to(F.col("x"), F.lit(Decimal("0.00"))).alias("r")).where("r IS NOT NULL").count() == 0


def test_equal_decimals_have_one_text_and_digest(spark):
    df = spark.sql("SELECT 1.50 AS a, 1.5000 AS b, 100 AS c, 100.0 AS d, 0.00 AS e")
    row = df.select(*(scalar.decimal_text(F.col(c)).alias(c) for c in "abcde")).first()
    assert tuple(row) == ("1.5", "1.5", "100", "100", "0")
    same = df.select((scalar.digest(["Decimal"], [F.col("a")]) == scalar.digest(["Decimal"], [F.col("b")])).alias("x")).first()
    assert same.x


def test_narrowing_is_exact_or_an_error(spark):
    df = spark.sql("SELECT CAST(1.25 AS decimal(20,5)) AS x")
    assert df.select(scalar.as_decimal(F.col("x"), 10, 2)).first()[0] == Decimal("1.25")
    with pytest.raises(Exception, match="decimal_inexact"):
        df.select(scalar.as_decimal(F.col("x"), 10, 1)).collect()


def test_products_are_exact_or_errors(spark):
    values = [Decimal(x) for x in ("0", "1.5", "-0.0000000003", "0.000001", "-123456789012.25", "987654321.0000000001", "999999999999999999.9999999999", "-7", "1000000000000000000")]
    wide = [v for v in values if abs(v) < 10**18]
    df = spark.createDataFrame([(a, b) for a in wide for b in wide], "x decimal(28,10), y decimal(28,10)")
    types = (df.schema["x"].dataType, df.schema["y"].dataType)
    product, bad = scalar.exact_product(F.col("x"), F.col("y"), *types)
    with localcontext(prec=80):
        for r in df.select("x", "y", product.alias("p"), F.coalesce(bad, F.lit(False)).alias("bad")).collect():
            exact = r.x * r.y
            if not r.bad:
                assert r.p == exact
            else:
                assert exact != round(exact, scalar.PRODUCT_SCALE) or abs(exact) > 10**22
    narrow = spark.sql("SELECT CAST(1.25 AS decimal(10,2)) x, CAST(0.05 AS decimal(10,4)) y")
    assert scalar.exact_product(F.col("x"), F.col("y"), *(f.dataType for f in narrow.schema))[1] is None


def test_collections_with_commas_have_keys_of_their_own(spark):
    df = spark.sql("SELECT array('a, b') AS x, array('a', 'b') AS y, array('a\", \"b') AS z")
    keys = df.select(*(scalar.value_key("Collection", F.col(c)) for c in "xyz")).first()
    assert len(set(keys)) == 3
