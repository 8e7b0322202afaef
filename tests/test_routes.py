"""The route search against a plain search that sorts all open paths on every turn."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from wanderlens.operators import routes


def sorted_search(start, goal, edges):
    onward = {}
    for src, dst, n in sorted(edges):
        onward.setdefault(src, []).append((dst, n))
    open_paths, closed = [(0, [start])], set()
    while open_paths:
        weight, path = open_paths[0]
        if path[-1] == goal:
            return float(weight), path
        longer = [(weight + n, [*path, c]) for c, n in onward.get(path[-1], []) if c not in closed]
        closed.add(path[-1])
        open_paths = sorted(longer + open_paths[1:], key=lambda p: -p[0])  # stable
    return 0.0, []


cell = st.integers(0, 6)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.tuples(cell, cell).filter(lambda p: p[0] != p[1]), st.integers(1, 4), max_size=14))
def test_search(graph):
    edges = [(a, b, n) for (a, b), n in graph.items()]
    assert routes.heaviest_first(0, 6, edges) == sorted_search(0, 6, edges)


def test_search_is_greedy():
    # The heavy start wins although the other way sums higher.
    assert routes.heaviest_first(0, 9, [(0, 1, 5), (1, 9, 1), (0, 2, 4), (2, 9, 9)]) == (6.0, [0, 1, 9])
    assert routes.heaviest_first(0, 9, [(0, 1, 5)]) == (0.0, [])


def test_routes_on_spark(spark, table):
    rng = random.Random(5)
    edges = {u: {(a, b): rng.randint(1, 3) for a, b in [rng.sample(range(8), 2) for _ in range(15)]} for u in range(200)}
    data = [(u, 0, 7, a, b, n) for u, graph in edges.items() for (a, b), n in graph.items()]
    frame = spark.createDataFrame(data, "user_id long, home long, work long, src long, dst long, n long")
    best = routes.best_route(frame)
    found = {r["user_id"]: (r["weight"], list(r["path"])) for r in best.collect()}
    assert found == {u: sorted_search(0, 7, [(a, b, n) for (a, b), n in g.items()]) for u, g in edges.items()}
    stations = table("base_station", [(0, 110.0, 20.0, None), (7, 111.0, 21.0, None)])
    drawn = spark.createDataFrame([(1, 0, 7, [0, 3, 7])], "user_id long, home long, work long, path array<long>")
    assert rows(routes.representative_route(drawn, stations)) == [
        (1, 0, 7, 110.0, 20.0, 111.0, 21.0, "110.0,20.0,None,None,111.0,21.0")
    ]
