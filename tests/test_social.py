import itertools
import random

from conftest import at, rows
from wanderlens.operators import social


def cdr(table, *calls):
    return table("cdr", [(at("01 08:00:00"), a, b, ms) for a, b, ms in calls])


def places(table, name, cells):
    return table(name, [(u, c, 110.0, 20.0) for u, c in cells])


def test_pairs_count_both_ends(table):
    pairs = social.undirected_pairs(cdr(table, (1, 2, 10), (2, 1, 20), (3, 3, 5), (1, None, 7), (None, 2, 7)))
    assert rows(pairs) == [(1, 2, 2, 30), (3, 3, 2, 10)]
    assert rows(social.both_directions(pairs)) == [(1, 2, 2, 30), (2, 1, 2, 30), (3, 3, 2, 10)]


def circles(table, calls, home, work):
    return social.circle_pairs(cdr(table, *calls), places(table, "user_home", home), places(table, "user_work", work))


def test_circles(table):
    found = circles(
        table, [(1, 2, 60000), (1, 3, 60000), (1, 4, 120000), (5, 6, 60000)],
        [(1, 10), (2, 10), (3, 11), (4, 10), (5, None), (6, None)], [(1, 50), (3, 50), (4, 50), (5, 51), (6, 52)],
    )
    # 1 and 4 share both; unknown homes match nothing.
    assert rows(social.social_circle_calls(found)) == sorted(
        [(0, 1, 1.0)] * 2 + [(0, 1, 2.0)] * 2 + [(1, 1, 1.0)] * 2 + [(1, 1, 2.0)] * 2 + [(2, 1, 1.0)] * 2
    )
    assert rows(social.circle_members(found, "family")) == [(1, 2), (1, 4), (2, 1), (4, 1)]
    assert rows(social.circle_members(found, "colleague")) == [(1, 3), (1, 4), (3, 1), (4, 1)]
    assert rows(social.circle_members(found, "friend")) == [(5, 6), (6, 5)]


def test_one_user_with_several_homes_keeps_pairs_single(table):
    found = circles(table, [(1, 2, 60000)], [(1, 10), (1, 11), (2, 11), (2, 10)], [])
    assert rows(social.social_circle_calls(found)) == [(0, 1, 1.0)] * 2


def test_features(table, spark):
    users = spark.createDataFrame([(1,), (2,), (9,)], "user_id long")
    calls = [(1, 2, 3600000), (2, 1, 1800000), (1, 3, 1000), (1, None, 5)]
    features = social.call_features(users, cdr(table, *calls))
    assert rows(features, "user_id", "all_contacts", "all_calls", "all_ms") == [(1, 2, 3, 5401000), (2, 1, 2, 5400000), (9, 0, 0, 0)]
    assert rows(features, "user_id", "callin_contacts", "callin_calls", "callin_hours") == [(1, 1, 1, 0.5), (2, 1, 1, 1.0), (9, 0, 0, 0.0)]
    assert rows(features, "user_id", "callout_contacts", "callout_calls") == [(1, 2, 2), (2, 1, 1), (9, 0, 0)]
    found = circles(table, calls, [(1, 10), (2, 10)], [(1, 5), (3, 5)])
    assert rows(social.circle_features(users, found), "user_id", "family_count", "family_calls", "colleague_ms", "friend_count") == [
        (1, 1, 2, 1000, 0), (2, 1, 2, 0, 0), (9, 0, 0, 0, 0)
    ]


def test_triangles_against_all_triples(table, spark):
    rng = random.Random(3)
    hub = [(0, v) for v in range(1, 60)]
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(250)} | set(hub)
    calls = [(a, b, 1) if rng.random() < 0.5 else (b, a, 1) for a, b in sorted(edges)]
    calls += calls[:50] + [(5, 5, 1), (6, None, 1)]
    residents = [u for u in range(62) if u != 7]
    kept = {e for e in edges if 7 not in e}
    counts = dict.fromkeys(residents, 0)
    for triple in itertools.combinations(range(60), 3):
        if all(pair in kept for pair in itertools.combinations(triple, 2)):
            for u in triple:
                counts[u] += 1
    found = social.triangle_count(spark.createDataFrame([(u,) for u in residents], "user_id long"), cdr(table, *calls))
    assert dict(rows(found)) == counts and counts[0] > 100
