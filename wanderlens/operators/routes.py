"""Representative routes from home to work."""

from __future__ import annotations

import heapq
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wanderlens.functions.times import second_of_day

MIN_ROUTE_CELLS = 3
Cell = int | str  # ids are numbers or text

# The search travels to the executors with the job: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def commuters(homes: DataFrame, works: DataFrame) -> DataFrame:
    """Users whose home and work cells differ."""
    home = homes.select("user_id", F.col("cell_id").alias("home"))
    work = works.select("user_id", F.col("cell_id").alias("work"))
    return home.join(work, "user_id").filter("home <> work").distinct()


def trajectory_steps(stops: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Cells of each (user, home, work, day) from the first home stop to the first work stop after it.

    Later home stops are skipped and a cell counts at its first position. Days that do not reach
    work give nothing. Moments are distinct first, which bounds a user's day by its seconds.
    """
    moments = stops.select("user_id", "day", second_of_day(F.col("ts")).alias("sec"), "cell_id").distinct()
    day = W.partitionBy("user_id", "day", "home", "work")
    numbered = moments.join(commuters(homes, works), "user_id").withColumn(
        "pos", F.row_number().over(day.orderBy("sec", "cell_id"))
    )
    start = F.min(F.when(F.col("cell_id") == F.col("home"), F.col("pos"))).over(day)
    reached = (F.col("cell_id") == F.col("work")) & (F.col("pos") > F.col("start"))
    end = F.min(F.when(reached, F.col("pos"))).over(day)
    on_way = numbered.withColumn("start", start).withColumn("end", end).filter("pos between start and end")
    return on_way.groupBy("user_id", "home", "work", "day", "cell_id").agg(F.min("pos").alias("pos"))


def daily_trajectory(stops: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Route of each (user, home, work, day) as ``#``-joined cells."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "cell_id")))
    cells = F.transform(ordered, lambda x: x["cell_id"].cast("string"))
    return trajectory_steps(stops, homes, works).groupBy("user_id", "home", "work", "day").agg(
        F.array_join(cells, "#").alias("route"), F.count(F.lit(1)).alias("cells")
    )


def transition_weights(stops: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """How often a user goes from one cell to the next, over day routes of at least three cells."""
    day = W.partitionBy("user_id", "day", "home", "work")
    steps = trajectory_steps(stops, homes, works).withColumn("cells", F.count(F.lit(1)).over(day))
    pairs = steps.filter(F.col("cells") >= MIN_ROUTE_CELLS).withColumn(
        "dst", F.lead("cell_id").over(day.orderBy("pos"))
    )
    return (
        pairs.filter("dst is not null").groupBy("user_id", "home", "work", F.col("cell_id").alias("src"), "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heaviest_first(start: Cell, goal: Cell, edges: list[tuple[Cell, Cell, int]]) -> tuple[float, list[Cell]]:
    """Path found by always extending the open path with the largest summed weight.

    Cells that were extended are not entered again. Of equal sums the path opened last goes first,
    and of one extension the lower cell id.
    """
    onward: dict[Cell, list[tuple[Cell, int]]] = {}
    for src, dst, n in sorted(edges):
        onward.setdefault(src, []).append((dst, n))
    extended: set[Cell] = set()
    open_paths: list[tuple[float, int, int, list[Cell]]] = [(0.0, 0, 0, [start])]
    turn = 0
    while open_paths:
        negative, _, _, path = heapq.heappop(open_paths)
        if path[-1] == goal:
            return -negative, path
        turn += 1
        for i, (cell, n) in enumerate(onward.get(path[-1], [])):
            if cell not in extended:
                heapq.heappush(open_paths, (negative - n, -turn, i, [*path, cell]))
        extended.add(path[-1])
    return 0.0, []


def _search(start: pd.Series, goal: pd.Series, edges: pd.Series) -> pd.DataFrame:
    found = [
        heaviest_first(s, g, [(e["src"], e["dst"], e["n"]) for e in es])
        for s, g, es in zip(start, goal, edges)
    ]
    return pd.DataFrame(found, columns=["weight", "path"])


def best_route(transitions: DataFrame) -> DataFrame:
    """Best route of each (user, home, work) over the transition weights: weight and array of cells.

    The edges of a user are already counted, at most one per cell pair of a month's routes.
    """
    cell = dict(transitions.dtypes)["src"]
    search = F.pandas_udf(_search, f"weight double, path array<{cell}>")
    edges = F.collect_list(F.struct("src", "dst", "n"))
    per_user = transitions.groupBy("user_id", "home", "work").agg(edges.alias("edges"))
    found = per_user.select("user_id", "home", "work", search("home", "work", "edges").alias("found"))
    return found.select("user_id", "home", "work", "found.weight", "found.path")


def representative_route(routes: DataFrame, stations: DataFrame) -> DataFrame:
    """Routes with coordinates: home, work, and the positions along the way.

    A cell without a station row keeps its place with unknown coordinates.
    """
    at = stations.select("cell_id", "lng", "lat").dropDuplicates(["cell_id"])
    stations_of = routes.select("user_id", "home", "work", F.posexplode("path").alias("pos", "cell_id")).join(
        at, "cell_id", "left"
    )
    point = F.concat_ws(
        ",", F.coalesce(F.col("lng").cast("string"), F.lit("None")), F.coalesce(F.col("lat").cast("string"), F.lit("None"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", point.alias("point"))))
    home, work = F.col("cell_id") == F.col("home"), F.col("cell_id") == F.col("work")
    return stations_of.groupBy("user_id", "home", "work").agg(
        *[
            F.max(F.when(place, F.col(c))).alias(f"{name}_{c}")
            for name, place in (("home", home), ("work", work)) for c in ("lng", "lat")
        ],
        F.array_join(F.transform(ordered, lambda x: x["point"]), ",").alias("route"),
    )
