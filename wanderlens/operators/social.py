"""Call graph: pair table, contact features, call circles and triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wanderlens.operators.spine import on_spine
from wanderlens.sources.stored import stored


def _answered(cdr: DataFrame) -> DataFrame:
    return cdr.filter("caller is not null and callee is not null")


def undirected_pairs(cdr: DataFrame) -> DataFrame:
    """Calls and total ms per unordered pair (a <= b). A call to oneself counts at both ends."""
    twice = F.when(F.col("a") == F.col("b"), 2).otherwise(1)
    return (
        _answered(cdr)
        .select(F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b"), "dur_ms")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("freq"), F.sum("dur_ms").alias("dur_ms"))
        .withColumn("freq", F.col("freq") * twice)
        .withColumn("dur_ms", F.col("dur_ms") * twice)
    )


def both_directions(pairs: DataFrame) -> DataFrame:
    """(user, contact) rows of unordered pairs: each pair once from either end."""
    ends = F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("user_id"), F.col("b").alias("contact")))
    ).otherwise(
        F.array(
            F.struct(F.col("a").alias("user_id"), F.col("b").alias("contact")),
            F.struct(F.col("b").alias("user_id"), F.col("a").alias("contact")),
        )
    )
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.inline(ends), *rest)


def contact_pairs(cdr: DataFrame) -> DataFrame:
    """Distinct (user, contact) in both directions."""
    ordered = _answered(cdr).select(
        F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")
    ).distinct()
    return both_directions(ordered)


def call_state(cdr: DataFrame) -> DataFrame:
    """One row per unordered pair (a <= b) with calls and ms either way: the state behind all call features."""
    forward = F.col("caller") <= F.col("callee")
    ends = _answered(cdr).select(
        F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b"), forward.alias("f"), "dur_ms")
    way = lambda name, there: [
        F.count_if(there).alias(f"{name}_calls"), F.coalesce(F.sum(F.when(there, F.col("dur_ms"))), F.lit(0)).alias(f"{name}_ms")]
    return ends.groupBy("a", "b").agg(*way("ab", F.col("f")), *way("ba", ~F.col("f")))


def contact_state(pairs: DataFrame) -> DataFrame:
    """(user, contact) rows of ``call_state`` with ``out`` and ``in`` calls and ms; a call to oneself is both."""
    def end(user: str, contact: str, out: str, received: str):
        return F.struct(
            F.col(user).alias("user_id"), F.col(contact).alias("contact"),
            F.col(f"{out}_calls").alias("out_calls"), F.col(f"{out}_ms").alias("out_ms"),
            F.col(f"{received}_calls").alias("in_calls"), F.col(f"{received}_ms").alias("in_ms"))

    both = F.array(end("a", "b", "ab", "ba"), end("b", "a", "ba", "ab"))
    rest = [c for c in pairs.columns if c not in ("a", "b", "ab_calls", "ab_ms", "ba_calls", "ba_ms")]
    return pairs.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(end("a", "b", "ab", "ab"))).otherwise(both)), *rest)


def with_circles(pairs: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Unordered pairs with flags for a shared home cell and a shared work cell.

    Unknown cells match nothing. The places of a user are held as sets, so that each pair stays
    one row however many places its ends have.
    """
    home = homes.filter("cell_id is not null").groupBy("user_id").agg(F.collect_set("cell_id").alias("home"))
    work = works.filter("cell_id is not null").groupBy("user_id").agg(F.collect_set("cell_id").alias("work"))
    places = home.join(work, "user_id", "full")
    at = pairs
    for end in ("a", "b"):
        at = at.join(
            places.select(
                F.col("user_id").alias(end), F.col("home").alias(f"{end}_home"), F.col("work").alias(f"{end}_work")
            ),
            end, "left",
        )

    def shared(place: str):
        return F.coalesce(F.arrays_overlap(f"a_{place}", f"b_{place}"), F.lit(False))

    return at.select(*pairs.columns, shared("home").alias("family"), shared("work").alias("colleague"))


def circle_pairs(cdr: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """Unordered call pairs (``a, b, freq, dur_ms``) with the flags ``family`` and ``colleague``."""
    return with_circles(undirected_pairs(cdr), homes, works)


CIRCLES = {"colleague": "colleague", "family": "family", "friend": "not colleague and not family"}


def circle_members(circles: DataFrame, circle: str) -> DataFrame:
    """(user, contact) pairs of one circle, in both directions."""
    return both_directions(circles.filter(CIRCLES[circle]).select("a", "b"))


def social_circle_calls(circles: DataFrame) -> DataFrame:
    """Per directed pair: type (0 same home, 1 same work, 2 neither), calls and minutes.
    A pair that shares both appears under both types."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("family"), 0),
            F.when(F.col("colleague"), 1),
            F.when(~F.col("family") & ~F.col("colleague"), 2),
        )
    )
    directed = both_directions(circles)
    return directed.select(
        F.explode(kinds).alias("type"), "freq", (F.col("dur_ms") / 60000).alias("minutes")
    )


@on_spine(all_contacts=0, all_calls=0, all_ms=0)
def all_call_features(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Distinct contacts, calls and total ms of each resident, over both directions."""
    return both_directions(undirected_pairs(cdr)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("all_contacts"),
        F.sum("freq").alias("all_calls"),
        F.sum("dur_ms").alias("all_ms"),
    )


def _one_way(cdr: DataFrame, user: str, name: str) -> DataFrame:
    return (
        _answered(cdr).groupBy("caller", "callee")
        .agg(F.count(F.lit(1)).alias("freq"), F.sum("dur_ms").alias("dur_ms"))
        .groupBy(F.col(user).alias("user_id")).agg(
            F.count(F.lit(1)).alias(f"{name}_contacts"),
            F.sum("freq").alias(f"{name}_calls"),
            (F.sum("dur_ms") / 3600000).alias(f"{name}_hours"),
        )
    )


@on_spine(callin_contacts=0, callin_calls=0, callin_hours=0.0)
def callin_features(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Distinct callers, calls and hours of the calls each resident received."""
    return _one_way(cdr, "callee", "callin")


@on_spine(callout_contacts=0, callout_calls=0, callout_hours=0.0)
def callout_features(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Distinct callees, calls and hours of the calls each resident made."""
    return _one_way(cdr, "caller", "callout")


def _call_columns() -> list:
    """The nine call features over the rows of ``contact_state``."""
    either = F.col("out_calls") + F.col("in_calls")
    columns = [
        F.count(F.lit(1)).alias("all_contacts"), F.sum(either).alias("all_calls"),
        F.sum(F.col("out_ms") + F.col("in_ms")).alias("all_ms")]
    for name, way in (("callin", "in"), ("callout", "out")):
        columns += [
            F.count_if(F.col(f"{way}_calls") > 0).alias(f"{name}_contacts"), F.sum(f"{way}_calls").alias(f"{name}_calls"),
            (F.sum(f"{way}_ms") / 3600000).alias(f"{name}_hours")]
    return columns


def call_features(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """All call features of a resident side by side, from one state per (user, contact)."""
    features = contact_state(call_state(cdr)).groupBy("user_id").agg(*_call_columns())
    return users.select("user_id").join(features, "user_id", "left").fillna(0)


_CIRCLE_COLUMNS = {f"{name}_{part}": 0 for name in CIRCLES for part in ("count", "calls", "ms")}


def _circle_columns(freq, dur_ms) -> list:
    """Members, calls and ms of the three circles over rows with the flags of ``with_circles``."""
    columns = []
    for name, condition in CIRCLES.items():
        member = F.expr(condition)
        columns += [
            F.count_if(member).alias(f"{name}_count"), F.sum(F.when(member, freq)).alias(f"{name}_calls"),
            F.sum(F.when(member, dur_ms)).alias(f"{name}_ms"),
        ]
    return columns


@on_spine(**_CIRCLE_COLUMNS)
def circle_features(users: DataFrame, circles: DataFrame) -> DataFrame:
    """Members, calls and ms per resident for colleagues, family and friends."""
    columns = _circle_columns(F.col("freq"), F.col("dur_ms"))
    return both_directions(circles).groupBy("user_id").agg(*columns)


@on_spine(triangles=0)
def triangle_count(users: DataFrame, cdr: DataFrame) -> DataFrame:
    """Triangles through each resident in the call graph among residents."""
    pairs = _answered(cdr).filter("caller <> callee").select(
        F.least("caller", "callee").alias("a"), F.greatest("caller", "callee").alias("b")
    ).distinct()
    return _triangles(users, pairs)


def _triangles(users: DataFrame, ordered: DataFrame) -> DataFrame:
    """Triangles per resident over distinct unordered pairs of different users.

    Edges point from the end with fewer neighbours to the other, which bounds every out-list by
    the square root of twice the edge count, however many neighbours a hub has.
    """
    for end in ("a", "b"):
        ordered = ordered.join(users.select(F.col("user_id").alias(end)), end, "left_semi")
    ordered = stored(ordered, "call-edges")
    degree = both_directions(ordered).groupBy("user_id").agg(F.count(F.lit(1)).alias("degree"))
    directed = ordered
    for end in ("a", "b"):
        directed = directed.join(
            degree.select(F.col("user_id").alias(end), F.col("degree").alias(f"{end}_degree")), end
        )
    forward = F.struct("a_degree", "a") < F.struct("b_degree", "b")
    edges = stored(
        directed.select(
            F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"),
            F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"),
        ),
        "call-arrows",
    )
    heads = edges.groupBy("src").agg(F.collect_list("dst").alias("out"))
    closing = (
        edges.join(heads, "src")
        .join(heads.select(F.col("src").alias("dst"), F.col("out").alias("dst_out")), "dst")
        .select("src", "dst", F.array_intersect("out", "dst_out").alias("third"))
        .filter(F.size("third") > 0)
    )
    # Each third corner, and the number of triangles over the edge for its two ends.
    corner = F.concat(
        F.transform("third", lambda v: F.struct(v.alias("user_id"), F.lit(1).alias("n"))),
        F.array(
            F.struct(F.col("src").alias("user_id"), F.size("third").alias("n")),
            F.struct(F.col("dst").alias("user_id"), F.size("third").alias("n")),
        ),
    )
    return closing.select(F.inline(corner)).groupBy("user_id").agg(F.sum("n").alias("triangles"))


def social_features(users: DataFrame, cdr: DataFrame, homes: DataFrame, works: DataFrame) -> DataFrame:
    """All call-graph features of a resident side by side.

    The calls are read and shuffled once, to the pair state, which is stored: the eighteen features of contacts are
    one aggregate over it, and the triangles take their edges from it.
    """
    pairs = stored(call_state(cdr), "call-pairs")
    directed = contact_state(with_circles(pairs, homes, works))
    either = F.col("out_calls") + F.col("in_calls"), F.col("out_ms") + F.col("in_ms")
    features = directed.groupBy("user_id").agg(*_call_columns(), *_circle_columns(*either))
    triangles = _triangles(users, pairs.filter("a <> b").select("a", "b"))
    return users.select("user_id").join(features, "user_id", "left").join(triangles, "user_id", "left").fillna(0)
