import pytest

from conftest import at, day, rows, stop
from wanderlens.operators import lodging, visitors

MONTH = "202401"


def seen(user, text, prov=301):
    return (user, at(text), 1, 110.0, 20.0, prov)


def test_detect_keeps_stays_of_3_to_15_days(table):
    records = []
    for user, last in ((1, 2), (2, 3), (3, 15), (4, 16)):
        records += [seen(user, "01 23:59:59"), seen(user, f"{last:02d} 00:00:00")]
    found = visitors.detect_visitors(table("visitor_record", records), MONTH)
    assert rows(found, "user_id", "stay_days") == [(2, 3), (3, 15)]


def test_detect_is_per_province_and_month(table):
    records = [seen(1, "01 08:00:00"), seen(1, "04 08:00:00"), seen(1, "05 08:00:00", 302), seen(1, "08 08:00:00", 302)]
    frame = table("visitor_record", records)
    found = visitors.detect_visitors(frame, MONTH)
    assert rows(found) == [(1, 301, day(1), day(4), 4), (1, 302, day(5), day(8), 4)]
    assert visitors.detect_visitors(frame, "202402").count() == 0


def two_province_visitor(table):
    return table("visitor", [(1, 301, day(1), day(4), 4), (1, 302, day(5), day(8), 4), (2, 301, day(1), day(3), 3)])


PORT, AIRPORT = (110.293096, 20.026518), (110.466232, 19.945878)


def test_transport_uses_first_and_last_day(table):
    v = table("visitor", [(1, 301, day(2), day(4), 3), (2, 301, day(2), day(4), 3)])
    stations = table("base_station", [(1, *PORT, None), (2, *AIRPORT, None), (3, 109.0, 19.0, None)])
    stops = table("visitor_stop", [
        stop(1, "01 08:00:00", 3), stop(1, "02 09:00:00", 2), stop(1, "02 08:00:00", 1),
        stop(1, "04 09:00:00", 1), stop(1, "04 10:00:00", 2), stop(1, "04 10:00:00", 3),
        stop(1, "04 23:00:00", 99),  # a cell without a station is left out
    ])
    assert rows(visitors.transport_in(v, stops, stations)) == [(1, 0), (2, 3)]
    # Equal times: the lower cell id decides.
    assert rows(visitors.transport_out(v, stops, stations)) == [(1, 1), (2, 3)]


def test_home_is_the_cell_with_most_night_hours(table):
    v = table("visitor", [(u, 301, day(1), day(4), 4) for u in (1, 2, 3, 4)])
    stations = table("base_station", [(1, 110.0, 20.0, None), (2, 111.0, 21.0, None)])
    stops = table("visitor_stop", [
        stop(1, "01 06:59:59", 2, 2), stop(1, "02 01:00:00", 1, 1.5), stop(1, "01 07:00:00", 1, 9),
        stop(1, "02 01:00:00", 1, 0.9),
        stop(2, "01 03:00:00", 77, 5), stop(2, "02 03:00:00", 1, 1),  # chosen before the station lookup
        stop(3, "01 03:00:00", 2, 1), stop(3, "02 03:00:00", 1, 1),
    ])
    home = visitors.visitor_home(v, stops, stations, MONTH)
    assert rows(home, "user_id", "home_cell") == [(1, 2), (2, None), (3, 1), (4, None)]
    assert rows(lodging.home_place_count(home)) == [(None, None, 2), (110.0, 20.0, 1), (111.0, 21.0, 1)]


def calls(table, *entries):
    return table("cdr", [(at(text), a, b, 1000) for text, a, b in entries])


def test_call_strength_limits(table):
    v = table("visitor", [(u, 301, day(1), day(4), 4) for u in (1, 2, 3, 4)])
    entries = [(f"01 0{i}:00:00", 1, 50) for i in range(3)]  # exactly 3
    entries += [("01 08:00:00", 2, 50), ("01 09:00:00", 50, 2)]  # 2
    entries += [(f"01 0{i}:00:00", 3, None) for i in range(6)]  # exactly 6
    entries += [(f"01 0{i}:00:00", 4, None) for i in range(7)] + [("02 08:00:00", 4, 50)] * 6  # 6.5
    assert rows(visitors.call_strength(v, calls(table, *entries))) == [(1, 2), (2, 1), (3, 2), (4, 3)]


def test_call_strength_of_a_user_with_two_provinces_counts_twice(table):
    found = visitors.call_strength(two_province_visitor(table), calls(table, *[("01 08:00:00", 1, 9)] * 2))
    assert rows(found) == [(1, 2), (1, 2), (2, 1)]


def test_visitor_type(table):
    v = table("visitor", [(u, 301, day(1), day(7 if u != 3 else 8), 7 if u != 3 else 8) for u in (2, 3, 4, 5)])
    residents = table("local_record", [(5, at("01 08:00:00"), 1, 1.0, 1.0, 327)])
    entries = [(f"01 0{i}:00:00", u, 50 + i) for u in (2, 3, 5) for i in range(3)]
    entries += [("01 08:00:00", 5, c) for c in (2, 3, 4)]
    cdr = calls(table, *entries)
    found = visitors.visitor_type(v, residents, cdr)
    # 2 is busy; 3 stays too long for business; 4 has half of its contacts, none, among the counted;
    # 5 is busy but half of its contacts are visitors.
    assert rows(found) == [(2, "business"), (3, "bird"), (4, "bird"), (5, "bird")]
    assert rows(visitors.visitor_type(v, residents, cdr, default_type="other")) == [
        (2, "business"), (3, "other"), (4, "other"), (5, "bird")
    ]


def test_duty_free_spots_and_hours(table):
    v = two_province_visitor(table)
    spots = table("scenic_spot", [(19, 1), (3, 2), (3, 4)])
    stops = table("visitor_stop", [
        stop(1, "01 02:00:00", 1, 1), stop(1, "01 03:00:00", 2, 2), stop(1, "02 03:00:00", 4, 3), stop(2, "01 03:00:00", 1, 0.9),
    ])
    assert rows(visitors.duty_free_visit(v, stops, spots, MONTH)) == [(1, "1"), (1, "1"), (2, "0")]
    assert rows(visitors.spot_visit_count(v, stops, spots, MONTH)) == [(1, 2, 6.0), (1, 2, 6.0), (2, 0, 0.0)]


def test_top3_pads_and_breaks_ties_by_position(table):
    v = table("visitor", [(u, 301, day(1), day(4), 4) for u in (0, 1, 2, 3)])
    stops = [stop(1, "01 08:00:00", 1, 1, 111.0, 20.0)]
    stops += [stop(2, f"01 0{i}:00:00", 1, 1, 112.0, 20.0) for i in (1, 2)] + [stop(2, "01 08:00:00", 2, 1, 111.0, 20.0)]
    stops += [stop(3, "01 08:00:00", i, 1, 110.0 + i, 20.0) for i in (4, 3, 2, 1)]
    found = visitors.top3_locations(v, table("visitor_stop", stops), MONTH)
    assert rows(found, "user_id", "lng1", "lng2", "lng3") == [
        (0, None, None, None), (1, 111.0, None, None), (2, 112.0, 111.0, None), (3, 111.0, 112.0, 113.0)
    ]


def test_max_dist_from_home(spark, table):
    v = table("visitor", [(u, 301, day(1), day(4), 4) for u in (1, 2)])
    homes = spark.createDataFrame([(1, 1, 110.0, 20.0), (2, None, None, None)], "user_id long, home_cell long, lng double, lat double")
    stops = table("visitor_stop", [stop(u, "01 08:00:00", 2, 1, 110.0, lat) for u in (1, 2) for lat in (20.5, 21.0)])
    found = dict(rows(visitors.max_dist_from_home(v, stops, homes, MONTH)))
    assert found[1] == pytest.approx(111.195, abs=0.01)
    assert found[2] == -1.0


def test_hotels_round_the_lodging(spark, table):
    stations = table("base_station", [(1, 110.0, 20.0, None), (2, 112.0, 20.0, 3000.0), (3, 113.0, 20.0, 50.0)])
    poi = table("poi", [
        (1, "a", "酒店;星级酒店", 110.0, 20.008, 1.0),  # 0.9 km, radius 1 km by default
        (2, "b", "酒店;星级酒店", 110.0, 20.0095, 1.0),  # 1.06 km
        (3, "c快捷公寓", "酒店", 110.0, 20.0, 1.0),
        (4, "d", "酒店;星级酒店", 110.0, 20.008, 1.0),
        (4, "d", "酒店;星级酒店", 110.0, 20.008, 1.0),  # the same hotel twice
        (5, "e", "酒店", 112.0, 20.02, 1.0),  # no label
        (6, "f", "购物", 113.0, 20.0, 1.0),
    ])
    homes = spark.createDataFrame([(7, 1), (8, 2), (9, 3), (10, None)], "user_id long, home_cell long")
    assert rows(lodging.hotel_classify(poi, stations, homes)) == [(7, "0|0|1#2"), (8, ""), (9, "None"), (10, "None")]


def test_profile_has_one_row_per_visitor_row(spark, table):
    v = two_province_visitor(table)
    stations = table("base_station", [(1, *PORT, None)])
    stops = table("visitor_stop", [stop(1, "08 02:00:00", 1, 2, *PORT)])
    spots = table("scenic_spot", [(19, 1)])
    poi = table("poi", [(1, "a", "酒店;星级酒店", *PORT, 1.0)])
    residents = table("local_record", [(5, at("01 08:00:00"), 1, 1.0, 1.0, 327)])
    profile = visitors.visitor_profile(
        v, stops, residents, calls(table, ("01 08:00:00", 1, 9)), spots, poi, stations, MONTH
    )
    assert len(profile.columns) == 19
    found = rows(profile, "user_id", "prov", "transport", "duty_free", "spots", "hours", "max_km", "home_cell", "hotel_type")
    assert found == [
        (1, 301, 0, "1", 1, 2.0, 0.0, 1, "0"), (1, 302, 0, "1", 1, 2.0, 0.0, 1, "0"),
        (2, 301, 3, "0", 0, 0.0, -1.0, None, "None"),
    ]
