import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wanderlens.functions import geo, scores, times
from wanderlens.functions.counts import province_bucket


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(column.alias("x")).first()["x"]


def test_distance(spark):
    col = [F.lit(v) for v in (110.0, 20.0, 110.0, 21.0)]
    assert one(spark, geo.distance_km(*col)) == pytest.approx(6371.004 * math.pi / 180)
    assert one(spark, geo.distance_km(F.lit(None).cast("double"), *col[1:])) is None


def test_transport_mode(spark):
    def mode(lng, lat, **kw):
        return one(spark, geo.transport_mode(F.lit(lng).cast("double"), F.lit(lat).cast("double"), **kw))

    assert mode(110.293096, 20.026518) == 0
    assert mode(110.466232, 19.945878) == 1
    assert mode(109.499415, 18.302055) == 2
    assert mode(None, None) == 3
    # 0.09 degrees of latitude are 10.008 km, 0.0899 are 9.996 km.
    assert mode(109.499415, 18.302055 - 0.09) == 3
    assert mode(109.499415, 18.302055 - 0.0899) == 2
    assert mode(109.499415, 18.302055 - 0.0899, max_km=2.0) == 3


def test_speed(spark):
    assert one(spark, geo.speed_kmh(F.lit(10.0), F.lit(1800))) == 20.0
    assert one(spark, geo.speed_kmh(F.lit(None).cast("double"), F.lit(1800))) == 0.0
    assert one(spark, geo.speed_kmh(F.lit(10.0), F.lit(0))) == 0.0


def test_month_bounds():
    assert times.month_bounds("202402") == (dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert times.month_bounds("202412") == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))


def test_month_days(spark):
    assert times.month_days(spark, "202402").count() == 29
    assert times.month_days(spark, "202401").count() == 31


def test_days_between(spark):
    a, b = F.lit(dt.date(2024, 1, 30)), F.lit(dt.date(2024, 2, 1))
    assert len(one(spark, times.days_between(a, b))) == 3
    assert one(spark, times.days_between(b, a)) == []


def test_stamps(spark):
    parsed = times.parse_stamp(F.lit("20240229235958"))
    millis = times.epoch_millis(parsed)
    assert one(spark, millis) == 1709251198000
    assert one(spark, times.millis_to_text(millis)) == "20240229235958"
    assert one(spark, times.seconds_apart(parsed, times.parse_stamp(F.lit("20240301000008")))) == 10


def test_stamps_do_not_depend_on_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        parsed = times.parse_stamp(F.lit("20240310023000"))  # skipped by summer time there
        assert one(spark, times.epoch_millis(parsed)) == 1710037800000
        assert one(spark, times.second_of_day(parsed)) == 9000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weekday(spark):
    assert [one(spark, times.is_weekday(F.lit(dt.date(2024, 1, d)))) for d in (1, 5, 6, 7)] == [True, True, False, False]


def test_tf_idf(spark):
    def score(*v):
        return one(spark, scores.tf_idf(*map(F.lit, v)))

    assert score(10, 4, 100, 20) == pytest.approx(0.4 * math.log(5))
    assert score(10, 4, 100, 0) == pytest.approx(0.4 * math.log(100))
    assert score(0, 0, 100, 20) == 1.0


@pytest.mark.parametrize(
    "name,tags,label",
    [
        ("X", "酒店;星级酒店", "0"),
        ("X快捷", "酒店;星级酒店", "0"),
        ("X", "酒店;快捷酒店", "1"),
        ("X家庭旅馆", "酒店;公寓式酒店", "3"),
        ("X公寓", "酒店;公寓式酒店", "none"),
        ("X快捷", "酒店;度假村", "none"),
        ("海滨客栈民宿", "酒店", "4#9"),
        ("情侣出租别墅", "酒店;其他", "10#11#12"),
        ("X", "酒店", "none"),
    ],
)
def test_hotel_label(spark, name, tags, label):
    assert one(spark, scores.hotel_label(F.lit(name), F.lit(tags))) == label


def test_province_bucket(spark):
    assert [one(spark, province_bucket(), prov=p) for p in (301, 300, 309, 327, 999)] == [301, 300, -1, -1, -1]
    assert one(spark, province_bucket("cast(null as int)")) == -1
