"""Nearest neighbours by collision-counting hashing.

Vectors are scaled to length one and projected on random lines; every projection keeps its values in sorted
order. Around the query's own value a window opens on each line, and a vector collides once for every window it
is in. Virtual rehashing widens all windows step by step, so only the newly covered ends are counted. A vector with
enough collisions is verified by its exact cosine. The k-th best cosine so far is a distance beyond which no vector
is wanted: windows never open wider than that distance asks for, and a query ends when they are as wide.

Rows are dealt into blocks of bounded size, each with sorted arrays of its own. A query first searches the block its own
row is in; the k-th cosine found there is the floor with which it goes to all other blocks, so that those open their
windows once and answer only what is above it. The answers of a query are merged by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterscope.llm.shared import ship, staged


@dataclass(frozen=True)
class Settings:
    """``lines`` projections; the windows' half widths as multiples of a difference's spread per unit of distance.

    A vector at distance r collides on a line when its difference, normal with spread r, is inside the window; with
    half width w = ``reach`` * R this happens for r = R in P(|z| < reach) of the lines, 0.68 for a reach of one.
    ``needed`` of the lines is a threshold 1.3 binomial deviations below that: one in ten vectors at the very distance R
    is missed, and far fewer of nearer ones. The more lines, the fewer farther vectors pass it.
    """

    lines: int = 256
    reach: float = 1.0
    needed: float = 0.645
    first: float = 0.3
    growth: float = 1.1
    block: int = 20_000
    part: int = 20_000
    tasks: int = 64
    seed: int = 7


# Projections are kept in single precision, so windows are wider by more than its error.
ROUNDING = 1e-4


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]


def block_answers(
    ids: np.ndarray,
    vectors: np.ndarray,
    query_ids: np.ndarray,
    queries: np.ndarray,
    floors: np.ndarray,
    k: int,
    settings: Settings,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The (query id, id, cosine) of up to k nearest rows of a block for each query, and how many pairs were verified.

    ``floors`` holds the cosine below which a query wants no row, or nan.
    """
    n, size = vectors.shape
    lines = np.random.default_rng(settings.seed).standard_normal((settings.lines, size))
    values = (lines @ unit_rows(vectors).T).astype(np.float32)
    order = np.argsort(values, axis=1).astype(np.int32)
    values = np.take_along_axis(values, order, axis=1)
    centres = (lines @ unit_rows(queries).T).astype(np.float32)
    threshold = int(np.ceil(settings.needed * settings.lines))
    norms, lengths = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, queries))
    found, pairs = [], 0
    for at in range(0, len(queries), 256):
        asked = np.arange(at, min(at + 256, len(queries)))
        counts = np.zeros((len(asked), n), dtype=np.int16)
        verified = np.zeros((len(asked), n), dtype=bool)
        low = np.stack([np.searchsorted(own, centre) for own, centre in zip(values, centres[:, asked])])
        high = low.copy()
        best = [(np.zeros(0, dtype=ids.dtype), np.zeros(0)) for _ in asked]
        floor = floors[asked]
        # the distance of the worst cosine wanted
        target = np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isnan(floor), -1.0, floor)))
        radius = np.where(np.isnan(floor), np.minimum(settings.first, target), target)
        active = np.arange(len(asked))
        while len(active):
            width = (radius[active] * settings.reach + ROUNDING).astype(np.float32)
            everything = radius[active] >= 2
            lo, hi = np.empty((settings.lines, len(active)), np.int64), np.empty((settings.lines, len(active)), np.int64)
            for j in range(settings.lines):
                centre = centres[j, asked[active]]
                lo[j] = np.searchsorted(values[j], centre - width, "left")
                hi[j] = np.searchsorted(values[j], centre + width, "right")
            lo[:, everything], hi[:, everything] = 0, n
            lo, hi = np.minimum(lo, low[:, active]), np.maximum(hi, high[:, active])
            for i, a in enumerate(active.tolist()):
                left = zip(order, lo[:, i].tolist(), low[:, a].tolist())
                right = zip(order, high[:, a].tolist(), hi[:, i].tolist())
                ends = [rows[x:y] for side in (left, right) for rows, x, y in side if x < y]
                if ends:
                    counts[a] += np.bincount(np.concatenate(ends), minlength=n).astype(np.int16)
                new = np.flatnonzero((counts[a] >= threshold) & ~verified[a])
                verified[a, new] = True
                q = asked[a]
                new = new[ids[new] != query_ids[q]]
                if len(new):
                    pairs += len(new)
                    cosine = (vectors[new] * queries[q]).sum(axis=1) / (norms[new] * lengths[q])
                    known, score = np.concatenate([best[a][0], ids[new]]), np.concatenate([best[a][1], cosine])
                    rank = np.lexsort((known, -score))
                    rank = rank[np.sort(np.unique(known[rank], return_index=True)[1])][:k]
                    best[a] = known[rank], score[rank]
                    if len(rank) == k:
                        target[a] = min(target[a], np.sqrt(max(0.0, 2 - 2 * score[rank[-1]])))
            low[:, active], high[:, active] = lo, hi
            active = active[radius[active] < target[active]]
            radius[active] = np.minimum(radius[active] * settings.growth, target[active])
        for q, (v, s) in zip(asked, best):
            found.append((np.full(len(v), query_ids[q]), v, s))
    query_id, vec_id, cosine = (np.concatenate(x) for x in zip(*found))
    return query_id, vec_id, cosine, pairs


def usable(column: Column) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return column.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(column, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """The k rows of largest cosine for every query row of ``vectors`` (vec_id, embedding), but the query's id itself.

    ``is_query`` tells from the id which rows are queries. Returns query_id, rank (from 1; ties to the smaller
    vec_id), vec_id, score (exact cosine in double precision). Null ids and vectors that are null, empty, zero, or
    hold null or non-finite components take no part. Vectors of different lengths are compared with their like
    only. Rows with the same vec_id are one candidate, the nearest of them; rows equal in both are read once, and others of
    one vec_id are spread over the blocks. Every row is indexed. An empty table
    gives no rows, and columns other than vec_id and embedding, whatever their names, are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["id", "vector"])
    rows = staged(rows.withColumn("size", F.size("vector")), "vectors")
    wanted = rows.filter(is_query(F.col("id"))).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own
    n_rows, n_wanted = rows.count(), wanted.count()
    blocks = max(1, -(-n_rows // settings.block))
    # enough tasks for a small table; each has a thousand queries at least, as it sorts its block's projections first
    parts = max(1, -(-n_wanted // settings.part), min(-(-settings.tasks // blocks), n_wanted // 1000))

    def dealt(df: DataFrame, own: str, n: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id", "vector"), F.lit(n)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        sides = [x for side in (left, right) for x in (side["id"].to_numpy(), np.stack(side["vector"].to_list()))]
        floors = right["floor"].to_numpy(dtype=float, na_value=np.nan)
        query_id, vec_id, score, _ = block_answers(*sides, floors, k, settings)
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    def answered(data: DataFrame, asked: DataFrame, *key: str) -> DataFrame:
        return data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")

    ship(vectors.sparkSession)
    data, asked = dealt(rows, "block", blocks), dealt(wanted, "block", blocks)
    answers = answered(data, asked.withColumn("floor", F.lit(None).cast("double")), "block", "size")
    if blocks > 1:
        answers = staged(answers, "own-block")
        scores = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        floors = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        floors = floors.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        elsewhere = asked.join(floors, "id", "left").withColumnRenamed("block", "home")
        elsewhere = dealt(elsewhere.withColumn("block", every(blocks)).filter("block != home"), "part", parts)
        answers = answers.unionByName(answered(data.withColumn("part", every(parts)), elsewhere, "block", "part", "size"))
    one = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
