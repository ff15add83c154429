"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length one and rotated at random; its code is the signs, packed to bits,
and its correction is the inner product of the vector with its code. A query is rotated alike and
rounded to a few bits per component, so its inner product with a code is a sum of counts of common
bits. Divided by the correction that is an unbiased estimate of the cosine, with a known bound of
its error. A vector is ranked by its true cosine if the estimate and the bound together reach
the k-th best true cosine met so far; all others cannot be among the nearest, but for the small
chance the bound leaves. Every row has a code and every query meets every code, in blocks.

Results: vectors that are null, empty, zero, or hold a null, NaN or infinite component take no
part, as query or as candidate; a query without candidates has no rows. Vectors meet only others of
their dimension. Ties go to the smaller id. Repeated ids stay apart rows of the same id, and a query
never meets its own id. An index or query set without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.plans.storage import stored

SEED = 7
QUERY_BITS = 4
#: Deviations of the estimate that the bound allows for.
SURE = 3.0
QUERY_BLOCK = 65_536
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4_096, 128


def rotation(size: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    drawn = np.random.default_rng(SEED).standard_normal((size, size))
    turned, triangle = np.linalg.qr(drawn)
    return turned * np.sign(np.diag(triangle))


def padded(size: int) -> int:
    return -(-size // 64) * 64


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors turned in a space of whole 64-bit words."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ rotation(padded(vectors.shape[1]))[: vectors.shape[1]]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, corrections): packed signs, and each unit vector's inner product with its code."""
    turned = rotated(vectors)
    bits = turned > 0
    codes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return codes, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


class Queries:
    """Rotated queries as planes of bits."""

    def __init__(self, vectors: np.ndarray):
        turned = rotated(vectors)
        self.size = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**QUERY_BITS - 1), 1e-12)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [
            np.packbits((levels >> b) & 1, axis=1, bitorder="little").view("<u8")
            for b in range(QUERY_BITS)
        ]
        self.total = levels.sum(axis=1, dtype=np.int64)

    def estimate(
        self, rows: slice, codes: np.ndarray, corrections: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosines, error bounds) of the chosen queries with all codes."""
        common = np.zeros((rows.stop - rows.start, len(codes)), dtype=np.int32)
        for bit, plane in enumerate(self.planes):
            for word in range(codes.shape[1]):
                counts = np.bitwise_count(plane[rows, word, None] & codes[None, :, word])
                common += counts.astype(np.int32) << bit
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        # signs are 2 * bit - 1, components are low + step * level
        signed = self.step[rows, None] * (2 * common - self.total[rows, None])
        signed += self.low[rows, None] * (2 * ones - self.size)[None, :]
        estimates = signed / (np.sqrt(self.size) * corrections)[None, :]
        spread = np.sqrt(np.maximum(1 - corrections**2, 0)) / corrections
        bounds = SURE * spread / np.sqrt(self.size - 1)
        rounding = self.step[rows, None] / corrections[None, :]
        return estimates, bounds[None, :] + rounding


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision; equal rows give equal values wherever they stand."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    return (vectors * query).sum(axis=1) / lengths


class Nearest:
    """The k nearest of each query among the rows shown so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.query_ids, self.vectors, self.k = ids, vectors, k
        self.queries = Queries(vectors)
        self.scores = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def show(self, ids, vectors, codes, corrections) -> None:
        for start in range(0, len(self.query_ids), QUERIES_AT_ONCE):
            rows = slice(start, min(start + QUERIES_AT_ONCE, len(self.query_ids)))
            estimates, bounds = self.queries.estimate(rows, codes, corrections)
            for i in range(rows.start, rows.stop):
                mine, bound = estimates[i - rows.start], bounds[i - rows.start]
                other = ids != self.query_ids[i]
                if self.scores[i, -1] == -np.inf and len(ids) > 4 * self.k:
                    # a first bar: the true cosines of the rows that look best
                    first = np.argpartition(-mine, 4 * self.k)[: 4 * self.k]
                    first = first[other[first]]
                    bar = self._kth(cosines(vectors[first], self.vectors[i]))
                else:
                    bar = self.scores[i, -1]
                chosen = np.flatnonzero((mine + bound >= bar) & other)
                if len(chosen):
                    self._take(i, ids[chosen], cosines(vectors[chosen], self.vectors[i]))

    def _kth(self, scores: np.ndarray) -> float:
        return -np.inf if len(scores) < self.k else np.sort(scores)[-self.k]

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids = np.concatenate([self.ids[i], ids])
        scores = np.concatenate([self.scores[i], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[best], scores[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column = np.nonzero(self.scores > -np.inf)
        return self.query_ids[row], self.ids[row, column], self.scores[row, column]


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles, dimension) of the rows that take part."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists(values, lambda v: v != 0)
    return table.where(F.col(key).isNotNull() & fine & nonzero).select(
        F.col(key).cast("bigint").alias("id"), values.alias("vector"), F.size(values).alias("size")
    )


def build_index(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector, size, code, correction) of every row that takes part, stored."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                codes, corrections = encode(matrix(part.column(1), size))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(corrections),
                    ],
                    names=["id", "vector", "size", "code", "correction"],
                )

    kinds = "id bigint, vector array<double>, size int, code binary, correction double"
    return stored(usable(table, key, vector).mapInArrow(work, kinds))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def nearest(index: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index to each query.

    Queries are sent to the tasks in blocks of at most ``QUERY_BLOCK``; each block is one pass over
    the index, in which a task keeps k rows per query. Partial results are merged per query.
    """
    spark = index.sparkSession
    asked = stored(usable(queries, key, vector))
    sizes = {r["size"]: r["n"] for r in asked.groupBy("size").agg(F.count("*").alias("n")).collect()}
    passes = []
    for size, n in sorted(sizes.items()):
        blocks = -(-n // QUERY_BLOCK)
        for block in range(blocks):
            chosen = asked.where(
                (F.col("size") == size) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
            ).toArrow()
            ids = chosen.column("id").to_numpy()
            vectors = matrix(chosen.column("vector").combine_chunks(), size)
            shared = spark.sparkContext.broadcast((ids, vectors))
            passes.append(one_pass(index.where(F.col("size") == size), shared, size, k))
    kinds = "query_id bigint, vec_id bigint, score double"
    partial = reduce(DataFrame.union, passes) if passes else spark.createDataFrame([], kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def one_pass(index: DataFrame, shared, size: int, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]):
        ids, vectors = shared.value
        best = Nearest(ids, vectors, k)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8")
                best.show(
                    batch.column(0).to_numpy(),
                    matrix(batch.column(1), size),
                    codes.reshape(batch.num_rows, -1),
                    batch.column(3).to_numpy(),
                )
        names = ["query_id", "vec_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found()], names=names)

    columns = index.select("id", "vector", "code", "correction")
    return columns.mapInArrow(work, "query_id bigint, vec_id bigint, score double")
