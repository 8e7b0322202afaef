"""Groups of users in the call graph: moves of independent nodes that raise modularity, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.operators.social import both_directions
from wanderlens.sources.stored import stored


# Weights, degrees and gains are whole numbers of up to 18 digits, their products decimals: results do
# not depend on the order of a sum.
_WHOLE = "decimal(18,0)"


def _arrows(pairs: DataFrame) -> DataFrame:
    """Weighted edges from both ends; calls to oneself say nothing about groups."""
    kept = pairs.filter("a <> b").select("a", "b", F.col("freq").cast("bigint").alias("w"))
    return both_directions(kept).select(F.col("user_id").alias("u"), F.col("contact").alias("v"), "w")


def _with_groups(arrows: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the groups of their ends; a group is split over as many tasks as its edges need."""
    return arrows.join(labels.select(F.col("node").alias("u"), F.col("label").alias("cu")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("cv")), "v"
    )


def _quality(ends: DataFrame, total: int) -> int:
    """Modularity times the square of the total weight."""
    per_group = ends.groupBy("cu").agg(
        F.sum("w").cast(_WHOLE).alias("degree"),
        F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0)).cast(_WHOLE).alias("inside"),
    )
    value = F.sum(F.col("inside") * F.lit(total).cast(_WHOLE) - F.col("degree") * F.col("degree"))
    return int(per_group.agg(value.alias("q")).first()["q"] or 0)


def _wishes(ends: DataFrame, total: int, turn: int) -> DataFrame:
    """``u, c, gain, draw``: the nodes that gain by moving, their best group, and what decides among neighbours.

    Weight to each group is summed before a node's groups are compared. Equal scores go to the own
    group, then to the smallest one.
    """
    degree = ends.groupBy("u", "cu").agg(F.sum("w").alias("k"))
    group = degree.groupBy(F.col("cu").alias("c")).agg(F.sum("k").alias("group_k"))
    ties = ends.filter("u <> v").groupBy("u", F.col("cv").alias("c")).agg(F.sum("w").alias("w"))
    own = degree.select("u", F.col("cu").alias("c"), F.lit(0).cast("bigint").alias("w"))
    options = ties.unionByName(own).groupBy("u", "c").agg(F.sum("w").alias("w"))
    scored = options.join(degree, "u").join(group, "c")
    stays = F.col("c") == F.col("cu")
    others = F.col("group_k") - F.when(stays, F.col("k")).otherwise(0)
    score = F.col("w").cast(_WHOLE) * F.lit(total).cast(_WHOLE) - F.col("k").cast(_WHOLE) * others.cast(_WHOLE)
    best = scored.groupBy("u", "cu").agg(
        F.min_by(F.struct("c", score.alias("score")), F.struct(-score, (~stays).cast("int"), "c")).alias("best"),
        F.max(F.when(stays, score)).alias("now"))
    draw = F.md5(F.concat(F.lit(f"{turn}:"), F.col("u").cast("string")))
    return best.filter("best.c <> cu").select(
        "u", F.col("best.c").alias("c"), (F.col("best.score") - F.col("now")).alias("gain"), draw.alias("draw"))


def _moves(arrows: DataFrame, wishes: DataFrame) -> DataFrame:
    """The wishes that come true: no neighbour wishes for more, or for as much with a smaller draw.

    They are an independent set of the graph, so two neighbours never move in the same round, and the
    largest wish is always among them.
    """
    other = wishes.select(F.col("u").alias("v"), F.col("gain").alias("other_gain"), F.col("draw").alias("other_draw"))
    beaten = (
        arrows.filter("u <> v").select("u", "v").join(wishes, "u").join(other, "v")
        .filter("other_gain > gain or (other_gain = gain and (other_draw < draw or (other_draw = draw and v < u)))")
        .select("u").distinct()
    )
    return wishes.join(beaten, "u", "left_anti").select(F.col("u").alias("node"), F.col("c").alias("to"))


def _connected(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label`` with every group cut into its connected parts, each named by its smallest node.

    Each round takes the smallest name among the neighbours in the group, and then the name of
    that node, so a name travels twice as far every time.
    """
    inner = stored(ends.filter("cu = cv and u <> v").select("u", "v"), "inner")
    names = stored(labels.select("node", F.col("node").alias("name")), "names")
    while True:
        offers = inner.join(names.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "name")
        least = offers.unionByName(names).groupBy("node").agg(F.min("name").alias("name"))
        jump = names.select(F.col("node").alias("name"), F.col("name").alias("further"))
        found = least.join(jump, "name").select("node", F.least("name", "further").alias("name"))
        after = stored(found, "names")
        settled = after.join(names.withColumnRenamed("name", "old"), "node").filter("name <> old").isEmpty()
        names = after
        if settled:
            return names.withColumnRenamed("name", "label")


def communities(pairs: DataFrame, min_gain: float = 1e-4) -> DataFrame:
    """Group of each user: ``user_id``, ``community`` (the smallest user id of the group).

    The rule, by which results are the same on any cluster:

    * A level starts with every node in a group of its own. In round t = 0, 1, … each node looks for the
      group in which modularity gains most, counted in whole numbers (total weight times the weight to the
      group, minus the node's degree times the degree of the group's other nodes; both directions of
      an edge count). Equal gains go to the own group, then to the smallest.
    * Of the nodes that gain by moving those move that no neighbour surpasses: by a larger gain, or an
      equal one and the smaller MD5 of ``t:node``.
    * The level ends when no node wants to move or two rounds in turn raise modularity by no more than
      ``min_gain``. Its best state counts, with groups cut into their connected parts.
    * If the level has gained more than ``min_gain``, its groups become the nodes of the next one.

    Every other round raises modularity by more than ``min_gain``, so the rounds end on any graph. Labels and
    edges are stored after each round; only single numbers come to the driver.
    """
    arrows = stored(_arrows(pairs), "arrows")
    total = int(arrows.agg(F.sum("w").alias("w")).first()["w"] or 0)
    members = arrows.select(F.col("u").alias("user_id"), F.col("u").alias("label")).distinct()
    if not total:
        return members.select("user_id", F.col("label").alias("community"))
    step = int(min_gain * total * total)
    while True:
        labels = arrows.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
        ends = stored(_with_groups(arrows, labels), "ends")
        before = quality = _quality(ends, total)
        best, best_ends, turn, idle = labels, ends, 0, 0
        while idle < 2:
            wishes = stored(_wishes(ends, total, turn), "wishes")
            if wishes.isEmpty():
                break
            moves = _moves(arrows, wishes)
            labels = stored(labels.join(moves, "node", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            ends = stored(_with_groups(arrows, labels), "ends")
            moved, turn = _quality(ends, total), turn + 1
            idle = 0 if moved > quality + step else idle + 1
            if moved > quality:
                best, best_ends, quality = labels, ends, moved
        best = _connected(best_ends, best)
        best_ends = stored(_with_groups(arrows, best), "ends")
        if _quality(best_ends, total) <= before + step:
            break
        joined = members.join(best.withColumnRenamed("label", "next"), F.col("label") == F.col("node"))
        members = stored(joined.select("user_id", F.col("next").alias("label")), "members")
        merged = best_ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        arrows = stored(merged, "arrows")
    names = members.groupBy("label").agg(F.min("user_id").alias("community"))
    return members.join(names, "label").select("user_id", "community")
