"""Exact top-k search: a Voronoi kNN join for integer inner products.

Queries and data are grouped by the nearest of a few pivots each (vectors of their own). A cell of data has a
summary: how many vectors it holds, how far the farthest is from the pivot, the greatest length, and the distances and
lengths of the k + 1 vectors nearest to the pivot. A group of queries, in
blocks, has a radius. With query q of a block
at pivot p with radius r, and vector x of a cell at pivot c, at distance d from it,

    p.c - |p| d - r |x|  <=  q.x  <=  p.c + |p| d + r |x|

so the summaries alone tell a score that a block's queries reach k times at least (one of the k + 1 may be the query
itself), and which cells can't reach it: those go to no task of the block. Of the other cells a vector is replicated
only where p.x + r |x| reaches that score, or the least k-th best score of the block's queries within a small sample
that everyone gets, whichever is higher. Blocks are salted, so that each task has a bounded block of queries and a
bounded share of the data; it solves them by a matrix product, and the best of all salts are merged.

Defined results: a vector that is null or has a null, NaN or infinite component takes no part; shorter vectors count
as ended by zeros; of rows with one id the least vector takes part, so ids are unique. Scores are exact: float64 where
every product is below 2^53, else Python integers; beyond a long's range they are given as its end, and ties among
those go to the smaller id like all ties. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import drop, stored

SCALE = 256
#: Queries in a block, at most on average; pivots and blocks are at most so many, which bounds what everyone gets.
BLOCK, MAX_PIVOTS, MAX_BLOCKS = 512, 256, 8192
#: Vectors for which there is one pivot.
PER_PIVOT = 400
#: Vectors of the sample, and of one salt's share, on average.
SAMPLE, SHARE = 2048, 20_000


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of integers (as float64, which holds them exactly), ended by zeros."""
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        v = np.frombuffer(x, "<f8")
        out[i, : len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = (np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return whole(q).dot(whole(x).T)


def vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * component) of each vector that takes part, as little-endian float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if x.is_valid and x.values.null_count == 0:
                    v = x.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(v).all() and np.isfinite(v := np.floor(scale * v)).all():
                        ids.append(i)
                        out.append((v + 0.0).astype("<f8").tobytes())  # no negative zero
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    some = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return some.mapInArrow(run, "id long, v binary").groupBy("id").agg(F.min("v").alias("v"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(ids) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(ids))
    if scores.dtype == object:
        return np.array(sorted(some, key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def to_pivots(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and the distance to it (rounded up)."""
    if not len(x) or not len(p):
        return np.zeros(len(x), np.int64), np.zeros(len(x))
    apart = np.maximum((x**2).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p**2).sum(axis=1)[None], 0)
    near = apart.argmin(axis=1)
    return near, np.sqrt(((x - p[near]) ** 2).sum(axis=1)) * (1 + 1e-9)


def assigned(data: DataFrame, p: np.ndarray) -> DataFrame:
    """data (id, v) with its cell, the distance to the cell's pivot and the length of the vector."""
    shared, dim = data.sparkSession.sparkContext.broadcast(p), p.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), dim)
            near, far = to_pivots(x, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far), pa.array(np.sqrt((x**2).sum(axis=1)))], names=["id", "v", "cell", "far", "length"])

    return data.mapInArrow(run, "id long, v binary, cell int, far double, length double")


def summaries(cells: DataFrame, k: int) -> tuple[dict, list]:
    """For each cell its radius and greatest length; and the cell, distance and length of its k + 1 vectors nearest to the pivot. Both are partly reduced before their shuffle, and bounded by the pivots."""
    wide = {r["cell"]: (r["far"], r["length"]) for r in cells.groupBy("cell").agg(F.max("far").alias("far"), F.max("length").alias("length")).collect()}
    order = Window.partitionBy("cell").orderBy("far", "id")
    first = cells.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("cell", "far", "length").collect()
    return wide, [tuple(r) for r in first]


def reached(blocks: list[tuple], groups: np.ndarray, p: np.ndarray, wide: dict, first: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of queries (pivot among groups, part, radius, bound by the sample) and cells of data at pivots p: the score to reach, and which cells may reach it."""
    at, radius = np.array([b[0] for b in blocks], np.int64), np.array([b[2] for b in blocks])
    long = np.sqrt((groups**2).sum(axis=1))
    scores = np.full((len(blocks), max(k + 1, len(first))), -np.inf)
    dots = groups @ p.T
    for i, (cell, far, length) in enumerate(first):
        scores[:, i] = dots[at, cell] - long[at] * far - radius * length
    # the k + 1st best: one of those vectors may be the query itself
    least = np.sort(scores, axis=1)[:, -(k + 1)] if len(blocks) else np.zeros(0)
    least = least - 1e-6 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    bound = np.maximum(least, np.array([b[3] for b in blocks], float))
    may = np.zeros((len(blocks), len(p)), bool)
    for cell, (far, length) in wide.items():
        most = dots[at, cell] + long[at] * far + radius * length
        may[:, cell] = most + 1e-6 * (1 + np.abs(most)) >= bound
    return bound, may


def top_k(rows: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best others. is_query: over the id, named id."""
    spark = rows.sparkSession
    data, data_at = stored(vectors(rows, key, vector), "vectors")
    r = data.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes"), F.count_if(is_query).alias("queries")).first()
    n, dim, n_queries = r["n"], (r["bytes"] or 0) // 8, r["queries"]
    spread = F.xxhash64("id")
    sample = data.orderBy(spread, "id").limit(SAMPLE).collect()
    s_ids, s = np.array([x["id"] for x in sample], np.int64), _matrix([bytes(x["v"]) for x in sample], dim)
    p = np.unique(s[: max(1, min(MAX_PIVOTS, -(-n // PER_PIVOT)))], axis=0) if len(s) else np.zeros((0, dim))
    first_queries = data.where(is_query).orderBy(spread, "id").limit(max(1, min(MAX_PIVOTS, -(-n_queries // BLOCK)))).collect()
    groups = _matrix([bytes(x["v"]) for x in first_queries], dim)
    shared = spark.sparkContext.broadcast((groups, s_ids, s))
    size = max(BLOCK, -(-n_queries // MAX_BLOCKS))
    cells, cells_at = stored(assigned(data, p), "cells")
    drop(spark, data_at)
    wide, first = summaries(cells, k)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, s_ids, s = shared.value
        for batch in batches:
            ids, q = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1).to_pylist(), dim)
            near, far = to_pivots(q, groups)
            scores = products(q, s).astype(np.float64)
            scores[ids[:, None] == s_ids[None]] = -np.inf
            bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
            bound = bound - 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far), pa.array(bound)], names=["id", "v", "pivot", "far", "bound"])

    queries = cells.where(is_query).select("id", "v")
    grouped, _ = stored(queries.mapInArrow(bounded, "id long, v binary, pivot int, far double, bound double"), "queries")
    held = {x["pivot"]: x["n"] for x in grouped.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # MAX_PIVOTS rows at most
    cut = F.element_at(F.create_map(*[F.lit(x) for c, m in (held or {0: 0}).items() for x in (c, max(1, -(-m // size)))]), F.col("pivot"))
    grouped = grouped.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), cut).cast("int"))
    summary = grouped.groupBy("pivot", "part").agg(F.max("far").alias("far"), F.min("bound").alias("bound")).collect()  # MAX_BLOCKS + MAX_PIVOTS rows at most
    all_blocks = [(x["pivot"], x["part"], x["far"], x["bound"]) for x in summary]
    bound, may = reached(all_blocks, groups, p, wide, first, k)
    blocks = spark.sparkContext.broadcast((np.array([b[0] for b in all_blocks], np.int64), np.array([b[2] for b in all_blocks]), bound, may))
    salts = max(1, -(-n // SHARE))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, (at, far, bound, may) = shared.value[0], blocks.value
        for batch in batches:
            x, cell, length = _matrix(batch.column(1).to_pylist(), dim), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            row, block = [], []
            for c in np.unique(cell):
                some, to = np.flatnonzero(cell == c), np.flatnonzero(may[:, c])
                upper = x[some] @ groups[at[to]].T + length[some][:, None] * far[to]
                i, j = np.nonzero(upper + 1e-6 * (1 + np.abs(upper)) >= bound[to])
                row.append(some[i])
                block.append(to[j])
            row, block = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (row, block))
            own = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(block.astype(np.int32))], names=["id", "v", "block"])

    salt = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(salts)).cast("int")
    copies = cells.select("id", "v", "cell", "length").mapInArrow(replicate, "id long, v binary, block int").withColumn("salt", salt)
    number = F.create_map(*[F.lit(x) for i, b in enumerate(all_blocks or [(0, 0, 0, 0)]) for x in (f"{b[0]}/{b[1]}", i)])
    asked = grouped.withColumn("block", F.element_at(number, F.concat_ws("/", "pivot", "part"))).select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        q_ids, x_ids = q["id"].to_numpy(), x["id"].to_numpy()
        xs = _matrix(x["v"].to_pylist(), dim)
        for at in range(0, len(q_ids) if len(x_ids) else 0, 64):
            ids = q_ids[at : at + 64]
            scores = products(_matrix(q["v"][at : at + 64].to_pylist(), dim), xs)
            for i, row in zip(ids.tolist(), scores):
                other = x_ids != i
                own, kept = x_ids[other], row[other]
                for j in best(kept, own, k):
                    out[0].append(i)
                    out[1].append(int(own[j]))
                    out[2].append(min(max(int(kept[j]), -(2**63)), 2**63 - 1))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("block", "salt").cogroup(copies.groupBy("block", "salt")).applyInArrow(solve, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int, k: int, scale: int = SCALE) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % {every} = 0 AND q.vec_id <> x.vec_id),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}
"""
