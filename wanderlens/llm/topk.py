"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt to blocks of about ``BLOCK`` rows. A block's index holds, for each dimension,
segments of rows with about equal values: ``LEVELS`` quantised impacts. A query takes the segments of
all dimensions by descending contribution and adds each segment's least contribution to its rows.
What a row can still gain is bounded by the next segments of every dimension and by the width of
the levels; a row whose bound is below the k-th least score so far cannot be a member. Work on a
block stops when this proof leaves ``RESCORE`` rows, or when the segments end; all rows that may be
members are then scored exactly from their vectors, and the best of each block meet in one window.

A contribution is counted from the worst value of its dimension, so that it is never negative:
for a negative weight the segments are taken from the other end.

Defined cases: null vectors and those with a null, NaN or infinite component take no part, neither
as queries nor as candidates; missing components of shorter vectors are 0; rows with the id of the
query are not its candidates; repeated rows are candidates each, equal queries are asked once; ties
go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanderlens.sources.stored import stored

BLOCK = 1 << 14
QUERIES = 256
LEVELS = 16
RESCORE = 128
CHECKS = 12
SCALE = 1024

FOUND = "query_id long, asked long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, v``: whole components of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)).select(
        "id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    return np.array([np.pad(v, (0, width - len(v))) for v in vectors], np.int64).reshape(len(vectors), width)


def _packed(matrix: np.ndarray) -> bytes:
    return struct.pack("<II", *matrix.shape) + matrix.astype("<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8", offset=8).reshape(struct.unpack_from("<II", data))


class Block:
    """The index of some rows: their values, and for each dimension the rows by level."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.width = (self.high - self.low) // LEVELS + 1
        level = (values - self.low) // self.width
        self.rows, self.segments = [], []
        for d in range(values.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            found, starts = np.unique(level[order, d], return_index=True)
            self.rows.append(np.split(order, starts[1:]))
            least = self.low[d] + found * self.width[d]
            self.segments.append((least, np.minimum(least + self.width[d] - 1, self.high[d])))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the best ``k`` and their scores; all ties are settled by id."""
        used = np.flatnonzero(query[: len(self.rows)])
        contributions, plan = {}, []
        for d in used:
            weight, (least, most) = int(query[d]), self.segments[d]
            if weight > 0:
                worst, best = weight * (least - self.low[d]), weight * (most - self.low[d])
                order = range(len(least) - 1, -1, -1)
            else:
                worst, best = weight * (most - self.high[d]), weight * (least - self.high[d])
                order = range(len(least))
            contributions[d] = [int(best[i]) for i in order]
            plan += [(int(best[i]), d, i, int(worst[i])) for i in order]
        plan.sort(key=lambda s: -s[0])
        error = {d: abs(int(query[d])) * int(self.width[d] - 1) for d in used}
        taken = dict.fromkeys(used, 0)
        slack = sum(max(error[d], contributions[d][0]) for d in used)
        score = np.zeros(len(self.ids), np.int64)
        mine = self.ids == own
        possible = np.flatnonzero(~mine)
        step = max(1, len(plan) // CHECKS)
        for at, (_, d, i, worst) in enumerate(plan, 1):
            score[self.rows[d][i]] += worst
            before = max(error[d], contributions[d][taken[d]])
            taken[d] += 1
            after = max(error[d], contributions[d][taken[d]]) if taken[d] < len(contributions[d]) else error[d]
            slack += after - before
            if (at % step == 0 or at == len(plan)) and len(possible) > k:
                bound = np.partition(score[possible], len(possible) - k)[len(possible) - k]
                possible = possible[score[possible] + slack >= bound]
                if len(possible) <= max(RESCORE, k):
                    break
        exact = self.values[possible][:, used] @ query[used]
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return possible[best], exact[best]


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy("<i8").tobytes()],
                         "values": [_packed(_matrix(rows["v"]))]})


def _in_blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows dealt in turn to blocks of about ``size``, a stored table with one row for each block."""
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.monotonically_increasing_id() % blocks)
    packed = dealt.groupBy("block").applyInPandas(_pack_group, "block long, ids binary, values binary")
    return stored(packed, "blocks"), blocks


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query``, a condition on the key, holds."""
    asked = quantised(vectors.where(is_query), key, vector, scale).dropDuplicates(["id", "v"])
    rows, blocks = _in_blocks(quantised(vectors, key, vector, scale), BLOCK)
    queries, _ = _in_blocks(asked, QUERIES)
    met = queries.select(
        F.col("ids").alias("query_ids"), F.col("values").alias("queries"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(rows, "block")

    def answer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_ids, queries, ids, values in batch.itertuples(index=False):
                index = Block(np.frombuffer(ids, "<i8"), _unpacked(values))
                found = []
                for own, query in zip(np.frombuffer(query_ids, "<i8"), _unpacked(queries), strict=True):
                    where, scores = index.search(query, int(own), k)
                    mark = int(np.frombuffer(hashlib.blake2b(query.tobytes(), digest_size=8).digest(), "<i8")[0])
                    found.append(pd.DataFrame({"query_id": own, "asked": mark, "vec_id": index.ids[where], "score": scores}))
                yield pd.concat(found)

    best = met.select("query_ids", "queries", "ids", "values").mapInPandas(answer, FOUND)
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
