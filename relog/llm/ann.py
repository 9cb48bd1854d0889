"""Approximate nearest neighbours by largest inner product, over shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint

CURVES, DIMS, BITS = 3, 4, 10
#: Bounds of the rows in a block of a curve, and the query blocks that meet a data block in one task.
BLOCKS, TOGETHER = (256, 4096), 32
#: The window is the smallest that holds this share of the true neighbours of SAMPLE queries on some curve.
#: Vectors in clusters take narrow windows; isotropic ones have no near neighbours on any curve and take a
#: constant share of the rows.
TARGET, SAMPLE = 0.95, 64
K = 20


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer cells (points x dims), by the transposed-index method: undo the excess
    work from the highest bit down, Gray-code, interleave the bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def curve_keys(vectors: DataFrame, dim: int, most: float, mean_square: float) -> DataFrame:
    """rep, curve, key. A vector is scaled by the largest norm and gets one more component that makes
    all norms 1, so that the largest inner products are the nearest points; every curve projects on
    its own directions, shifts, and orders the cells of the projections' distribution."""
    rng = np.random.default_rng(11)
    ways = [np.linalg.qr(rng.normal(size=(dim + 1, min(DIMS, dim + 1))))[0] for _ in range(CURVES)]
    shifts = rng.random((CURVES, min(DIMS, dim + 1)))
    spread = max(np.sqrt(mean_square / dim) / most, 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("vector").flatten(), dtype=np.float64).reshape(-1, dim) / most
            x = np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])
            for c in range(CURVES):
                u = (1 / (1 + np.exp(-1.7 * np.clip(x @ ways[c] / spread, -20, 20))) + shifts[c]) / 2
                key = hilbert(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(np.full(len(x), c), pa.int32()), pa.array(key, pa.int64())], names=["rep", "curve", "key"])

    return vectors.select("rep", "vector").mapInArrow(run, "rep long, curve int, key long")


def with_ranks(keys: DataFrame, n: int) -> DataFrame:
    """rep, curve, rank: the place of each of n rows on each curve. Rows are sorted by ranges of (curve, key,
    rep), so equal keys don't gather in one task, and a row's place is its place in its range after the rows
    of all ranges before."""
    ordered = checkpoint(keys.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep"))
    placed = ordered.withColumn("id", F.monotonically_increasing_id()).select("rep", "curve", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return checkpoint(placed.join(F.broadcast(offsets), "part").select("rep", "curve", (F.col("offset") + F.col("at") - F.col("curve") * F.lit(n)).alias("rank")))


def half_window(reps: DataFrame, ranks: DataFrame, k: int, target: float) -> int:
    """How far apart on its nearest curve a query and its neighbour are, for the share `target` of the k true
    neighbours of SAMPLE queries (those of the smallest hashes): these are searched in all rows, block by block."""
    chosen = reps.where(F.col("asks") == 1).orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(SAMPLE).select("rep", "vector").collect()
    if not chosen:
        return 0
    ids, x = np.array([r["rep"] for r in chosen]), np.array([r["vector"] for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rep = batch.column("rep").to_numpy()
                score = x @ np.array(batch.column("vector").flatten(), dtype=np.float64).reshape(len(rep), -1).T
                score[ids[:, None] == rep[None, :]] = -np.inf
                top = np.argsort(-score, axis=1)[:, :k]
                q = np.repeat(ids, top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rep[top.ravel()]), pa.array(np.take_along_axis(score, top, axis=1).ravel())], names=["query", "rep", "score"])

    found = reps.select("rep", "vector").mapInArrow(run, "query long, rep long, score double").where("query != rep")
    top = found.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("at") <= k)
    asked = ranks.join(F.broadcast(reps.sparkSession.createDataFrame([(int(i),) for i in ids], "rep long")), "rep").select(F.col("rep").alias("query"), "curve", F.col("rank").alias("own"))
    gaps = ranks.join(F.broadcast(top), "rep").join(F.broadcast(asked), ["query", "curve"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    got = [r["gap"] for r in gaps.collect()]  # SAMPLE x k rows
    return int(np.quantile(got, target, method="higher")) if got else 0


def best(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k + 1 vectors of a data block for each of its queries, ties to the smaller least id; scores are
    sums over the original vectors in one fixed order, so that a pair scores alike wherever it meets."""
    data, queries = group[group["role"] == 0], group[group["role"] == 1]
    rows = []
    if len(data) and len(queries):
        x, ids, least = np.stack(data["vector"].to_list()).astype(np.float64), data["rep"].to_numpy(), data["least"].to_numpy()
        norm = float(np.sqrt((x * x).sum(axis=1).max()))
        for at in range(0, len(queries), 512):
            q = np.stack(queries["vector"].iloc[at : at + 512].to_list()).astype(np.float64)
            near = q @ x.T
            n = min(k + 1, near.shape[1])
            # the product's rounding may order ties otherwise: all that are as near within it stay until scored
            reach = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n] - 1e-12 * norm * np.sqrt((q * q).sum(axis=1))
            for i in range(len(q)):
                top = np.flatnonzero(near[i] >= reach[i])
                score = (x[top] * q[i]).sum(axis=1)
                order = np.lexsort((least[top], -score))[: k + 1]
                rows.append((int(queries["rep"].iloc[at + i]), ids[top][order].tolist(), least[top][order].tolist(), score[order].tolist()))
    return pd.DataFrame(rows, columns=["query", "ids", "leasts", "scores"])


def neighbours(vectors: DataFrame, k: int = K, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors (vec_id, embedding) for each row
    whose vec_id is divisible by `every`, ties to the smaller vec_id.

    Equal vectors are searched once (a hot vector is one row) and stand for their k + 1 smallest ids,
    which are all that a result can hold; of equally near ones those of smaller ids stay. How far a query's
    window reaches on every curve is measured on a sample of queries (half_window). Each curve is cut into
    blocks of half a reach; a query meets the blocks that its window touches, and candidates of all curves
    merge: k + 1 of a block travel, and the best of these stay for each query.

    Vectors that are null, zero, of another length than most, or with null or non-finite components
    take no part, nor do null ids. A repeated id counts once for each different vector; an id is never
    its own neighbour. An empty table gives an empty result."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    dim = good.agg(F.mode(F.size("vector"))).first()[0] or 1
    good = good.where(F.size("vector") == dim).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))
    ids = good.select("h1", "h2", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for part in (["h1", "h2", "salt"], ["h1", "h2"]):
        ids = ids.withColumn("n", F.row_number().over(W.partitionBy(*part).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    members = ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    reps = checkpoint(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("vector").alias("vector"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks")).join(members, ["h1", "h2"]).withColumn("rep", F.xxhash64("h1", "h2")))
    n, most, square = reps.agg(F.count("*"), F.max(norm := F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), F.avg(norm)).first()
    ranks = with_ranks(curve_keys(reps, dim, float(np.sqrt(most or 1.0)), float(square or 1.0)), n)
    reach = half_window(reps, ranks, k, target)
    block = min(max(-(-reach // 2), BLOCKS[0]), BLOCKS[1])
    blocks, side = max(1, -(-n // block)), -(-reach // block)
    placed = ranks.select("rep", "curve", F.floor(F.col("rank") / block).cast("int").alias("block")).join(reps.select("rep", "least", "vector", "asks"), "rep")
    low, high = F.greatest(F.col("block") - side, F.lit(0)), F.least(F.col("block") + side, F.lit(blocks - 1))
    # queries of TOGETHER blocks form a team, so that a group holds a block of data and a bounded number of queries
    asks = placed.where(F.col("asks") == 1).select("curve", F.floor(F.col("block") / TOGETHER).alias("team"), F.explode(F.sequence(low, high)).alias("block"), F.lit(1).alias("role"), "rep", "least", "vector")
    data = placed.select("curve", F.explode(F.sequence(F.floor(low / TOGETHER), F.floor(high / TOGETHER))).alias("team"), "block", F.lit(0).alias("role"), "rep", "least", "vector")
    found = data.unionByName(asks).groupBy("curve", "team", "block").applyInPandas(lambda g: best(g, k), "query long, ids array<long>, leasts array<long>, scores array<double>")
    each = found.select("query", F.explode(F.arrays_zip("ids", "leasts", "scores")).alias("x")).select("query", F.col("x.ids").alias("rep"), F.col("x.leasts").alias("least"), (-F.col("x.scores")).alias("far"))
    # the best of a query's distinct candidates: a vector met on all curves counts CURVES times at first
    some = each.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy("far", "least", "rep"))).where(F.col("at") <= CURVES * (2 * k + 2)).drop("at").distinct()
    top = some.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy("far", "least", "rep"))).where(F.col("at") <= 2 * k + 2).select("query", "rep", "far")
    owned = top.groupBy("query", "rep").agg(F.min("far").alias("far")).join(reps.select("rep", "members"), "rep")
    ranked = owned.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(F.col("far"), m.alias("vec_id")))))), 1, k + 1 + k).alias("near"))
    queries = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("h1", "h2").alias("query")).distinct()
    own = queries.join(ranked, "query").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
