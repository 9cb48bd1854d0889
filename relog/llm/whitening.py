"""Whitening of vectors by their covariance's leading eigenvectors, found by LOBPCG.

The covariance matrix is never made: a task multiplies its centred rows with a block of directions, and
only the products' sum (dimensions x block) reaches the driver, over a tree of tasks. Each round makes one
such product, of the residuals; iterate and previous directions carry theirs along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

COMPONENTS, GUARD = 8, 16
#: Certified: |V b - e b| is at most this times the largest eigenvalue, from a product made anew.
RESIDUAL, ROUNDS = 1e-12, 1000
#: An eigenvalue under this share of the largest is no variance.
NONE = 1e-12
SCALE, SHIFT, CLIP = 1024, 100_000, 2.0**52
BLOCK_BYTES = 8 << 20
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def in_blocks(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The usable vectors as integers x in blocks (ids, x as bytes of 64-bit integers), checkpointed, and their
    dimension."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    lengths = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, c = batch.column("vec_id"), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = np.clip(np.floor(SCALE * c), -CLIP, CLIP).astype("<i8") + SHIFT
            step = max(1, BLOCK_BYTES // (8 * dim))
            for i in range(0, len(x), step):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + step].to_pylist()], pa.list_(pa.int64())), pa.array([x[i : i + step].tobytes()], pa.binary())], ["ids", "x"])

    return checkpoint(good.where(F.size("v") == dim).mapInArrow(block, "ids array<long>, x binary")), dim


def matrices(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for x in batch.column("x"):
        yield np.frombuffer(x.as_py(), "<i8").reshape(-1, dim)


def summed(blocks: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `of` (an array of one shape and type) over all blocks: one row a task, then a tree of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in matrices(batch, dim):
                part = of(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str]), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["sum", "type", "shape"])

    parts = blocks.mapInArrow(partial, "sum binary, type string, shape array<int>")
    return parts.rdd.map(lambda r: np.frombuffer(bytes(r[0]), r[1]).reshape(r[2])).treeReduce(np.add)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n; the numerator is exact where it fits 64 bits."""
    if np.abs(x).max(initial=0).astype(float) * n < 2.0**62:
        return (n * x - sums) / n
    return x - sums / n


def orthonormal(block: np.ndarray, image: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """An orthonormal basis of the block's columns without those that others nearly make up, and the same
    combinations of image."""
    if not block.shape[1]:
        return block, image
    size = np.linalg.norm(block, axis=0)
    keep = size > 0
    block = block[:, keep] / size[keep]
    u, s, w = np.linalg.svd(block, full_matrices=False)
    found = s > 1e-8 * max(s.max(initial=0), 1e-300)
    if image is None:
        return u[:, found], None
    return u[:, found], (image[:, keep] / size[keep]) @ (w[found].T / s[found])


def without(block: np.ndarray, basis: np.ndarray, image: np.ndarray | None = None, basis_image: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The block's part that is orthogonal to an orthonormal basis, with image alike; twice, against rounding."""
    for _ in range(2):
        share = basis.T @ block
        block = block - basis @ share
        if image is not None:
            image = image - basis_image @ share
    return block, image


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, guard: int = GUARD, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix without
    negative eigenvalues, given by its product with a block. Rayleigh-Ritz on [iterate, residuals, previous
    directions]; guard columns beside the k wanted hold close eigenvalues apart."""
    m = min(dim, k + guard)
    x, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, m)))
    ax = product(x)
    p, ap = np.zeros((dim, 0)), np.zeros((dim, 0))
    fresh = True
    for _ in range(ROUNDS):
        e, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        e, turn = e[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        r = ax - x * e
        if np.linalg.norm(r[:, :k], axis=0).max() <= RESIDUAL * max(e[0], 0.0) or not np.any(ax):
            if fresh:
                return e[:k], x[:, :k]
            x, _ = np.linalg.qr(x)  # certify by a product that no sums of earlier ones are in
            ax, p, ap, fresh = product(x), np.zeros((dim, 0)), np.zeros((dim, 0)), True
            continue
        basis, images = np.hstack([x, p]), np.hstack([ax, ap])
        w = orthonormal(without(r, basis)[0])[0]
        w = orthonormal(without(w, basis)[0])[0][:, : dim - basis.shape[1]]
        if not w.shape[1]:  # rounding is all that is left to improve
            if fresh:
                raise ArithmeticError("residuals could not be certified")
            x, _ = np.linalg.qr(x)
            ax, p, ap, fresh = product(x), np.zeros((dim, 0)), np.zeros((dim, 0)), True
            continue
        basis, images = np.hstack([basis, w]), np.hstack([images, product(w)])
        inner = basis.T @ images
        _, c = np.linalg.eigh((inner + inner.T) / 2)
        c = c[:, ::-1][:, :m]
        moved = c.copy()
        moved[:m] = 0  # the new iterate without what the old one gave
        x, ax, p, ap = basis @ c, images @ c, basis @ moved, images @ moved
        p, ap = orthonormal(*without(p, x, ap, ax))
        p, ap = p[:, : max(0, dim - m)], ap[:, : max(0, dim - m)]
        fresh = False
    raise ArithmeticError(f"no certified residuals after {ROUNDS} rounds")


def whitened_vectors(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, as in ROWS, of vectors (vec_id,
    embedding): k rows (fewer, if there are fewer dimensions) for each vector.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another
    length than the most frequent one (of equally frequent ones the longer). Repeated rows all count; ids may be
    null or repeated. Entries beyond 2^52/1024 count as that. An eigenvector's sign makes its largest entry
    positive. A component without variance (one vector, equal vectors, fewer vectors than components) has whitened
    and explained 0, and shows in identity_error. deviation is null where it doesn't fit 64 bits. Without
    usable vectors there are no rows."""
    spark = vectors.sparkSession
    blocks, dim = in_blocks(vectors)
    if not dim:
        return spark.createDataFrame([], ROWS)
    first = summed(blocks, dim, lambda x: np.append(x.sum(axis=0), len(x)))
    sums, n = first[:-1], int(first[-1])

    def product(b: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ b)

        return summed(blocks, dim, of) / n

    trace = float(summed(blocks, dim, lambda x: np.square(centred(x, n, sums)).sum(keepdims=True).reshape(1))[0]) / n
    e, b = lobpcg(product, dim, min(k, dim))
    b = b * np.where(np.take_along_axis(b, np.abs(b).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    varies = e > NONE * e[0] if e[0] > 0 else np.zeros(len(e), bool)
    explained = np.where(varies, e / trace if trace else 0.0, 0.0)
    b = b * np.where(varies, 1 / np.sqrt(np.where(varies, e, 1.0)), 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ b
        return np.vstack([w.T @ w, w.sum(axis=0)])

    second = summed(blocks, dim, moments) / n
    error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(len(e))).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids"), matrices(batch, dim), strict=True):
                c = centred(x, n, sums)
                rows, per = len(x), len(e)
                fits = np.square(c * n).sum(axis=1) < 2.0**62
                away = np.where(fits, np.square(n * x - sums).sum(axis=1), 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(ids.as_py(), object), per), pa.int64()),
                        pa.array(np.tile(np.arange(1, per + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * per, n, np.int64)),
                        pa.array(np.repeat(away, per), pa.int64(), mask=np.repeat(~fits, per)),
                        pa.array((c @ b).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * per, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(out, ROWS)
