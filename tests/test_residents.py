"""Resident features: limits by hand, and the window forms against plain loops on random days."""

import random

import pytest

from conftest import at, day, rows, stop
from wanderlens.operators import residents, routes, social

HOME, WORK = 1, 2


def place(user, cell, lng=110.0, lat=20.0):
    return (user, cell, lng, lat)


def test_calls(table, spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    cdr = table("cdr", [(at("01 08:00:00"), a, b, 1) for a, b in ((1, 2), (1, 2), (2, 1), (1, None), (None, 1), (1, 1), (8, 9))])
    assert rows(residents.call_records_per_user(users, cdr)) == [(1, 7), (2, 3), (3, 0)]
    assert rows(residents.callin_contacts(users, cdr)) == [(1, 2), (2, 1), (3, 0)]
    assert rows(residents.callout_contacts(users, cdr)) == [(1, 2), (2, 1), (3, 0)]


def test_leaving_home_before_four_does_not_count(table):
    homes = table("user_home", [place(1, HOME), (2, HOME, None, None)])
    stops = [stop(1, "02 03:00:00", HOME), stop(1, "02 04:59:58", 5)]  # midpoint 3:59:59
    assert rows(residents.home_left_time(table("local_stop", stops), homes)) == []
    stops += [stop(1, "02 08:00:00", HOME), stop(1, "02 10:00:00", 5)]
    assert rows(residents.home_left_time(table("local_stop", stops), homes)) == [(1, 9.0)]
    exact = [stop(1, "02 03:00:00", HOME), stop(1, "02 05:00:00", 5), stop(1, "06 08:00:00", HOME), stop(1, "06 09:00:00", 5)]
    assert rows(residents.home_left_time(table("local_stop", exact), homes)) == [(1, 4.0)]  # the 6th is a Saturday
    unknown = table("local_stop", [stop(2, "02 08:00:00", HOME), stop(2, "02 10:00:00", 5)])
    assert rows(residents.home_left_time(unknown, homes)) == []
    assert rows(residents.home_left_time(unknown, homes, known_only=False)) == [(2, 9.0)]


def test_leaving_work_in_the_last_second_does_not_count(table):
    works = table("user_work", [place(1, WORK)])
    late = table("local_stop", [stop(1, "02 23:59:59", WORK)])
    assert rows(residents.work_left_time(late, works)) == []


def random_days(count, seed):
    rng = random.Random(seed)
    stops = []
    for user in range(count):
        for d in rng.sample(range(1, 15), 3):
            for sec in rng.sample(range(86400), rng.randint(1, 9)):
                ts = at(f"{d:02d} {sec // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}")
                stops.append((ts.date(), user, ts, rng.choice([HOME, HOME, WORK, WORK, 5, 6]), rng.choice([0.5, 1.0, 6.5]), 110.0, 20.0))
    return stops


def by_day(stops):
    days = {}
    for d, user, ts, cell, *_ in stops:
        days.setdefault((user, d), []).append((ts.hour * 3600 + ts.minute * 60 + ts.second, cell))
    return {key: sorted(v) for key, v in days.items()}


def weekday_means(stops, per_day):
    sums = {}
    for (user, d), seen in by_day(stops).items():
        if d.weekday() < 5:
            hours = per_day(user, seen)
            if hours is not None:
                sums.setdefault(user, []).append(hours)
    return {user: sum(v) / len(v) for user, v in sums.items()}


def left_home(user, seen):
    for (before, a), (after, b) in zip(seen, seen[1:]):
        if a == HOME and b != HOME and (before + after) / 2 >= 4 * 3600:
            return (before + after) / 2 / 3600
    return None


def left_work(user, seen):
    last = max((i for i, (_, cell) in enumerate(seen) if cell == WORK), default=None)
    if last is None:
        return None
    sec = seen[last][0] if last + 1 == len(seen) else (seen[last][0] + seen[last + 1][0]) / 2
    return (86399 - sec) / 3600 or None


def reached_work(user, seen):
    first = next((i for i, (_, cell) in enumerate(seen) if cell == WORK), None)
    if first is None:
        return None
    return ((seen[first][0] if first == 0 else (seen[first][0] + seen[first - 1][0]) / 2) / 3600) or None


def test_rhythm_against_loops(table):
    stops = random_days(300, 7)
    frame = table("local_stop", stops + stops[::5])  # repeated stops change nothing
    homes = table("user_home", [place(u, HOME) for u in range(300)])
    works = table("user_work", [place(u, WORK) for u in range(300)])
    left = weekday_means(stops, left_work)

    def came_home(user, seen):
        if user not in left:
            return None
        later = [(86399 - sec) / 3600 for sec, cell in seen if cell == HOME]
        return next((h for h in later if h < left[user]), 0.0)

    for result, loop in (
        (residents.home_left_time(frame, homes), left_home),
        (residents.work_left_time(frame, works), left_work),
        (residents.work_arrival_time(frame, works), reached_work),
        (residents.home_arrival_time(frame, homes, residents.work_left_time(frame, works)), came_home),
    ):
        expected = weekday_means(stops, loop)
        found = dict(map(tuple, result.collect()))
        assert found.keys() == expected.keys() and len(found) > 100
        assert all(found[u] == pytest.approx(expected[u]) for u in found)


def walked(seen):
    """Cells from the first home stop to the first work stop after it, each once."""
    cells = [cell for _, cell in seen]
    if HOME not in cells:
        return []
    rest = cells[cells.index(HOME) + 1:]
    if WORK not in rest:
        return []
    return list(dict.fromkeys([HOME, *[c for c in rest[:rest.index(WORK) + 1] if c != HOME]]))


def test_trajectories_against_loops(table):
    stops = random_days(300, 8)
    frame = table("local_stop", stops + stops[::5])
    homes = table("user_home", [place(u, HOME) for u in range(300)])
    works = table("user_work", [place(u, WORK if u % 10 else HOME) for u in range(300)])
    expected = {k: walked(v) for k, v in by_day(stops).items() if k[0] % 10}
    found = {(r["user_id"], r["day"]): r["route"] for r in routes.daily_trajectory(frame, homes, works).collect()}
    assert found == {k: "#".join(map(str, v)) for k, v in expected.items() if v} and len(found) > 50
    weights = {}
    for (user, _), path in expected.items():
        if len(path) >= 3:
            for pair in zip(path, path[1:]):
                weights[user, *pair] = weights.get((user, *pair), 0) + 1
    edges = routes.transition_weights(frame, homes, works).collect()
    assert {(e["user_id"], e["src"], e["dst"]): e["n"] for e in edges} == weights and weights


def test_radius_trips_and_commute(table, spark):
    users = spark.createDataFrame([(u,) for u in (1, 2, 3)], "user_id long")
    homes = table("user_home", [place(1, HOME), (2, HOME, None, None), place(3, HOME)])
    works = table("user_work", [place(1, WORK, 110.0, 20.1), place(2, WORK), (3, WORK, None, None)])
    stops = table("local_stop", [
        stop(1, "02 08:00:00", 5, 1.0, 110.0, 20.5), stop(1, "02 09:00:00", 6, 1.0, 110.0, 20.2), stop(1, "02 10:00:00", 7, 0.9, 110.0, 25.0),
        stop(1, "03 08:00:00", 5, 1.0, 110.0, 20.3), stop(1, "04 08:00:00", WORK, 1.0, 110.0, 29.0),
        stop(1, "06 08:00:00", 5, 6.0, 110.0, 20.1), stop(1, "07 08:00:00", 5, 7.0, 110.0, 20.1), stop(1, "06 09:00:00", 5, 5.9, 110.0, 20.1),
        stop(1, "06 10:00:00", 5, 6.0, 110.0, 20.0899), stop(1, "06 11:00:00", WORK, 8.0, 110.0, 21.0),
        stop(2, "06 08:00:00", 5, 8.0, 110.0, 29.0), stop(3, "06 08:00:00", 5, 8.0, 110.0, 29.0),
    ])
    degree = 111.1950802
    assert dict(rows(residents.life_radius(stops, homes, works)))[1] == pytest.approx(0.4 * degree, rel=1e-6)
    # 0.1 degrees are 11.1 km; 0.0899 are 9.996 km. Unknown places never make a trip.
    assert rows(residents.weekend_trips(users, stops, homes, works)) == [(1, 2, 13.0), (2, 0, 0.0), (3, 0, 0.0)]
    commute = dict(rows(residents.commute_dist(users, homes, works)))
    assert commute[1] == pytest.approx(0.1 * degree, rel=1e-6) and commute[2] == commute[3] == 0.0


def test_resident_spots(table, spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    spots = table("scenic_spot", [(1, 10), (1, 11), (2, 20)])
    stops = table("local_stop", [stop(1, "01 01:00:00", c, 0.5) for c in (10, 11, 20, 99)])
    assert rows(residents.resident_spot_visits(users, stops, spots)) == [(1, 2, 1.5), (2, 0, 0.0)]


def test_work_hours_and_rank(table, spark):
    works = table("user_work", [place(u, WORK) for u in (1, 2, 3)])
    homes = table("user_home", [place(u, 100 + u) for u in (1, 2, 3)])
    stops = table("local_stop", [
        stop(1, "02 08:00:00", WORK, 3.0), stop(1, "02 12:00:00", WORK, 2.0), stop(1, "03 08:00:00", WORK, 3.0),
        stop(2, "02 08:00:00", WORK, 6.0), stop(3, "02 08:00:00", WORK, 1.0), stop(3, "06 08:00:00", WORK, 2.0), stop(1, "02 08:00:00", 9, 9.0),
    ])
    hours = residents.work_hours(stops, works)
    assert rows(hours) == [(1, 4.0), (2, 6.0), (3, 1.0)]
    assert rows(residents.work_hours(stops, works, weekend=True)) == [(3, 2.0)]
    cdr = table("cdr", [(at("01 08:00:00"), a, b, 1) for a, b in ((1, 2), (3, 1))])
    circles = social.circle_pairs(cdr, homes, works)
    assert rows(residents.circle_rank(circles, hours, "work_hours", more=True)) == [(1, 0.5), (2, 0.0), (3, 1.0)]
    assert rows(residents.circle_rank(circles, hours, "work_hours", more=False)) == [(1, 0.5), (2, 1.0), (3, 0.0)]


def test_ways_between_home_and_work(table):
    homes = table("user_home", [place(1, HOME), place(2, HOME), place(2, 7), place(3, HOME), place(4, HOME)])
    works = table("user_work", [place(1, WORK), place(2, WORK), place(3, HOME), place(4, WORK)])
    days = [
        stop(1, "02 07:00:00", WORK),  # nothing at home before it
        stop(1, "02 07:30:00", HOME), stop(1, "02 08:00:00", HOME), stop(1, "02 08:20:00", 5), stop(1, "02 09:00:00", WORK),
        stop(1, "02 12:00:00", HOME), stop(1, "02 13:00:00", WORK), stop(1, "02 17:00:00", WORK), stop(1, "02 17:45:00", HOME),
        stop(1, "02 20:00:00", HOME),
        stop(1, "03 08:00:00", HOME), stop(1, "03 08:00:00", WORK), stop(1, "03 10:00:00", WORK),  # the first second is no way
        stop(1, "06 08:00:00", HOME), stop(1, "06 20:00:00", WORK),  # a Saturday
        stop(2, "02 08:00:00", HOME), stop(2, "02 08:30:00", WORK), stop(2, "02 18:00:00", 7),
        stop(3, "02 08:00:00", HOME), stop(3, "02 09:00:00", HOME),
        stop(4, "02 09:00:00", WORK), stop(4, "03 08:00:00", HOME),
    ]
    got = residents.commute_time(table("local_stop", days * 2), homes, works)
    assert rows(got, "user_id", "home", "work", "days_to_work", "to_work_h", "days_to_home", "to_home_h") == [
        (1, HOME, WORK, 2, 1.5, 1, 0.75), (2, HOME, WORK, 1, 0.5, 0, None), (2, 7, WORK, 0, None, 1, 9.5)]


def test_ways_equal_loops(table):
    stops = random_days(40, 12)
    homes = table("user_home", [place(u, HOME) for u in range(40)] + [place(u, 5) for u in range(0, 40, 3)])
    works = table("user_work", [place(u, WORK) for u in range(40)] + [place(u, 6) for u in range(0, 40, 4)])
    expected = {}
    for (user, d), moments in by_day(stops).items():
        if d.isoweekday() > 5:
            continue
        for home in [HOME, *[5] * (user % 3 == 0)]:
            for work in [WORK, *[6] * (user % 4 == 0)]:
                there = [(w, max(h for h, c in moments if c == home and h < w)) for w, c in moments
                         if c == work and any(h < w for h, e in moments if e == home)]
                back = [(w, min(h for h, c in moments if c == home and h > w)) for w, c in moments
                        if c == work and any(h > w for h, e in moments if e == home)]
                ways = expected.setdefault((user, home, work), ([], []))
                ways[0].extend([w - h for w, h in there[:1]])
                ways[1].extend([h - w for w, h in back[-1:]])
    mean = lambda x: round(sum(x) / len(x) / 3600, 9) if x else None
    got = residents.commute_time(table("local_stop", stops), homes, works).collect()
    found = {(r.user_id, r.home, r.work): (r.days_to_work, r.to_work_h and round(r.to_work_h, 9), r.days_to_home, r.to_home_h and round(r.to_home_h, 9)) for r in got}
    assert found == {k: (len(a), mean(a), len(b), mean(b)) for k, (a, b) in expected.items() if a or b}
