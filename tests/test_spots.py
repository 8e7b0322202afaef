import pytest

from conftest import at, day, rows, stop
from wanderlens.functions.counts import PROVINCE_COLUMNS
from wanderlens.operators import movement, spots

MONTH = "202401"


@pytest.fixture()
def cells(table):
    return table("scenic_spot", [(1, 10), (1, 11), (2, 20), (3, 30)])


@pytest.fixture()
def visitor(table):
    # User 1 is seen with two provinces.
    return table("visitor", [
        (1, 301, day(1), day(4), 4), (1, 302, day(5), day(8), 4), (2, 309, day(1), day(3), 3), (3, 301, day(1), day(12), 12),
    ])


def test_spot_stops_hours_and_month(table, cells):
    stops = table("visitor_stop", [
        stop(1, "01 06:59:59", 10), stop(1, "01 07:00:00", 10), stop(1, "01 20:59:59", 10), stop(1, "01 21:00:00", 10),
        stop(1, "01 12:00:00", 10, 0.99), stop(1, "01 12:00:00", 99),
    ])
    assert rows(spots.spot_stops(stops, cells, MONTH), "ts") == [(at("01 07:00:00"),), (at("01 20:59:59"),)]
    assert spots.spot_stops(stops, cells, "202402").count() == 0
    assert spots.spot_stops(stops, cells).count() == 2


def visits(table, cells, *stops):
    return spots.spot_stops(table("visitor_stop", list(stops)), cells, MONTH)


def test_province_flows(table, cells, visitor):
    v = visits(table, cells, stop(1, "01 08:00:00", 10), stop(1, "01 09:00:00", 11), stop(1, "02 08:00:00", 10),
               stop(2, "01 08:00:00", 10), stop(9, "01 08:00:00", 10))
    assert rows(spots.spot_flow_prov_month(v, visitor), "spot", "p_301", "p_302", "p_else") == [(1, 2, 2, 1)]
    assert rows(spots.spot_flow_prov_day(v, visitor), "spot", "day", "p_301", "p_302", "p_else") == [
        (1, day(1), 1, 1, 1), (1, day(2), 1, 1, 0)
    ]
    flow = spots.spot_flow_month(v, visitor)
    assert rows(flow, "spot", "total", "d1", "d2", "d3") == [(1, 3, 2, 1, 0)]
    g = 100 * (4 + 4 + 1) ** 0.5 / 5
    assert rows(spots.spot_concentration(v, visitor))[0][1] == pytest.approx(g)


def test_hours_of_day(table, cells, visitor):
    v = visits(table, cells, stop(1, "01 08:00:00", 10), stop(1, "01 08:30:00", 11), stop(1, "01 20:59:59", 10))
    assert rows(spots.spot_flow_day_hour(v, visitor), "spot", "h7", "h8", "h20", "h21") == [(1, 0, 1, 1, 0)]


def test_flow_of_the_month_counts_people_once(table, visitor):
    records = table("visitor_record", [
        (1, at("01 08:00:00"), 1, 1.0, 1.0, 301), (1, at("01 09:00:00"), 1, 1.0, 1.0, 301), (1, at("31 08:00:00"), 1, 1.0, 1.0, 301),
        (1, at("31 08:00:00"), 1, 1.0, 1.0, 302), (2, at("31 08:00:00"), 1, 1.0, 1.0, 309), (9, at("31 08:00:00"), 1, 1.0, 1.0, 301),
    ])
    flow = spots.visitor_flow_by_prov(records, visitor, MONTH)
    assert rows(flow, "period", "total", "p_301", "p_302", "p_else") == [
        ("202401", 3, 1, 1, 1), ("20240101", 1, 1, 0, 0), ("20240131", 3, 1, 1, 1)
    ]
    for row in flow.collect():
        assert row["total"] == sum(row[c] for c in PROVINCE_COLUMNS)


def test_stays_count_every_stop_and_visitor_row(table, cells, visitor):
    v = visits(table, cells, stop(2, "01 08:00:00", 10, 1.25), stop(2, "01 08:00:00", 10, 1.25), stop(3, "01 08:00:00", 11, 1.5),
               stop(1, "01 08:00:00", 20, 2.5), stop(3, "01 08:00:00", 20, 1.0))
    # Spot 1: 2.5 and 1.5 hours. Spot 2: user 1 has two visitor rows, so 5 hours, and 1 hour.
    assert rows(spots.spot_avg_stay(v, visitor)) == [(1, 2.0), (2, 3.0)]
    assert rows(spots.spot_stay_hist(v, visitor)) == [(1, 1, 1, 0, 0, 0), (2, 1, 0, 0, 0, 1)]


def test_transport_tables(spark, visitor):
    transport = spark.createDataFrame([(1, 0), (2, 3), (3, 0)], "user_id long, transport int")
    assert rows(spots.transport_by_prov(transport, visitor), "transport", "p_301", "p_302", "p_else") == [(0, 2, 1, 0), (3, 0, 0, 1)]
    assert rows(spots.prov_by_transport(transport, visitor)) == [(301, 2, 0, 0, 0), (302, 1, 0, 0, 0), (309, 0, 0, 0, 1)]


def test_histogram_of_stay_days_and_calendar(visitor):
    assert [n for _, n in rows(spots.stay_days_hist(visitor).orderBy("stay_days"))].count(0) == 10
    assert dict(rows(spots.stay_days_hist(visitor)))[4] == 1  # distinct users
    calendar = {r["day"]: (r["n_in"], r["n_out"]) for r in spots.daily_in_out(visitor, MONTH).collect()}
    assert len(calendar) == 31 and calendar[day(1)] == (3, 0) and calendar[day(8)] == (0, 1)
    assert len(spots.daily_in_out(visitor, "202402").collect()) == 29


def test_rank_keeps_spots_without_visits(table, cells, visitor):
    v = visits(table, cells, stop(2, "01 08:00:00", 10, 3.0))
    ranked = spots.spot_rank(cells, spots.spot_flow_month(v, visitor), spots.spot_avg_stay(v, visitor))
    assert rows(ranked) == [(1, 1, 3.0, 0.003), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]


def moves(table, cells, visitor, *stops, **kw):
    all_stops = spots.spot_stops(table("visitor_stop", list(stops)), cells)
    return rows(movement.migration_day(all_stops, visitor, **kw))


def test_migration(table, cells, visitor):
    path = [stop(2, "01 08:00:00", 10), stop(2, "01 09:00:00", 20), stop(2, "01 10:00:00", 11), stop(2, "01 11:00:00", 20),
            stop(2, "02 08:00:00", 30), stop(3, "01 08:00:00", 10), stop(3, "01 09:00:00", 20)]
    assert moves(table, cells, visitor, *path) == [(day(1), 1, 2, 2), (day(1), 2, 1, 1)]


def test_migration_pairs_of_a_spot_with_itself(table, cells, visitor):
    twice = [stop(2, "01 08:00:00", 10), stop(2, "01 08:00:00", 11), stop(2, "01 09:00:00", 20)]
    assert moves(table, cells, visitor, *twice) == [(day(1), 1, 1, 1), (day(1), 1, 2, 1)]
    assert moves(table, cells, visitor, *twice, include_self=False) == [(day(1), 1, 2, 1)]
    # A user with two visitor rows has every stop twice after the join.
    assert moves(table, cells, visitor, stop(1, "01 08:00:00", 10)) == [(day(1), 1, 1, 1)]


def test_migration_month_is_the_sum_of_days(spark):
    daily = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 4), (2, 2, 1, 1)], "day int, s1 int, s2 int, n long")
    assert rows(movement.migration_month(daily)) == [(1, 2, 7), (2, 1, 1)]


def test_hot_routes_and_support(table, cells, visitor):
    people = table("visitor", [(u, 301, day(1), day(4), 4) for u in range(1, 5)] + [(9, 301, day(1), day(9), 9)])
    stops = []
    for user in (1, 2, 9):
        stops += [stop(user, "01 08:00:00", 10), stop(user, "01 09:00:00", 20), stop(user, "02 09:00:00", 11), stop(user, "03 09:00:00", 30)]
    stops += [stop(3, "01 08:00:00", 20), stop(3, "01 09:00:00", 10), stop(4, "01 08:00:00", 10)]
    v = visits(table, cells, *stops)
    assert rows(movement.hot_routes(v, people, 3, 5)) == [("1#2", 2), ("1#2#3", 2), ("1#3", 2), ("2#3", 2)]
    # Half of four sequences: two users. The route of one user alone falls away.
    assert rows(movement.hot_routes(v, people, 3, 5, min_support=0.75)) == []
    assert rows(movement.hot_routes(v, people, 6, 10)) == [("1#2", 1), ("1#2#3", 1), ("1#3", 1), ("2#3", 1)]
    assert movement.hot_routes(v, people, 11, 15).count() == 0


def test_bands_share_one_mining(spark, table, cells, visitor):
    """Random visits with users of two bands: every band as if mined alone, and as counted by loops."""
    import itertools
    import random
    from collections import Counter

    rng = random.Random(21)
    people, stops = [], []
    for user in range(40):
        people += [(user, 301 + i, day(1), day(d), d) for i, d in enumerate(rng.sample([3, 5, 6, 9, 11, 15, 16], rng.randint(1, 2)))]
        stops += [stop(user, f"{rng.randint(1, 9):02d} {rng.randint(7, 20):02d}:00:00", rng.choice([10, 11, 20, 30])) for _ in range(rng.randint(1, 7))]
    v, people = visits(table, cells, *stops), table("visitor", people)
    bands = [(3, 5), (6, 10), (11, 15)]
    sequences = movement.spot_sequences(v, people, bands)
    frequent = movement.frequent_routes(sequences, 3, 0.2)
    found = {(r.band, r.route): r.freq for r in frequent.collect()}
    expected = {}
    rows_ = sequences.collect()
    for i in range(3):
        own = [r.sequence for r in rows_ if r.bands >> i & 1]
        counts = Counter("#".join(c) for s in own for k in (2, 3, 4) for c in set(itertools.combinations(s, k)))
        expected |= {(i, route): n for route, n in counts.items() if n >= 0.2 * len(own)}
    assert found == expected and len({b for b, _ in found}) == 3
    for i, band in enumerate(bands):
        alone = rows(movement.hot_routes(v, people, *band, min_support=0.2))
        assert rows(movement.best_routes(frequent).filter(f"band = {i}"), "route", "freq") == alone
