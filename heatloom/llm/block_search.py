"""Exact nearest neighbours by a block matrix join over int8 codes with error bounds.

Vectors are packed into blocks. Every query block meets every candidate block in
a tile: the product of the int8 codes gives distances that are wrong by at most
the sum of both vectors' quantisation errors, so only candidates whose lower
bound is within the k-th smallest upper bound are computed again on the original
vectors. Tiles keep k rows for each query, which are merged by heaps of k: once in
the task that made them, once where all rows of a query meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.session import materialise

QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
TILE = "query_id long, query_key long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each vector, and a bound on how far each lies from its code."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, error * (1 + 1e-9) + 1e-9 * scale


def code_distances(q: np.ndarray, q_scale: np.ndarray, c: np.ndarray, c_scale: np.ndarray) -> np.ndarray:
    """Distances between the vectors that the codes stand for. Sums of up to 1,024 products of int8 are whole numbers that float32 holds."""
    dot = np.zeros((len(q), len(c)))
    for k in range(0, q.shape[1], 1024):
        dot += q[:, k : k + 1024].astype(np.float32) @ c[:, k : k + 1024].astype(np.float32).T
    square = lambda x, s: (x.astype(np.int64) ** 2).sum(1) * s**2
    d2 = square(q, q_scale)[:, None] + square(c, c_scale) - 2 * q_scale[:, None] * c_scale * dot
    return np.sqrt(np.maximum(d2, 0))


def tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the candidate and distance of the k nearest of a tile, ties to the smaller id.

    A candidate equal to the query in id and vector is the query itself.
    """
    (qc, qs, qe), (cc, cs, ce) = quantise(q), quantise(c)
    near = code_distances(qc, qs, cc, cs)
    slack = qe[:, None] + ce + 1e-6 * (near + np.sqrt((q**2).sum(1))[:, None])
    n = min(k + 1, len(c))  # the query itself may be among them
    limit = np.partition(near + slack, n - 1, axis=1)[:, n - 1 : n]
    row, at = np.nonzero(near - slack <= limit)
    square = np.zeros(len(row))
    for j in range(q.shape[1]):  # in order of the components, in double precision
        square += (q[row, j] - c[at, j]) ** 2
    score = np.sqrt(square)
    other = ~((q_ids[row] == c_ids[at]) & (square == 0))
    row, at, score = row[other], at[other], score[other]
    order = np.lexsort((c_ids[at], score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return row[place < k], at[place < k], score[place < k]


def _unpack(block: pa.StructArray, i: int) -> tuple[np.ndarray, ...]:
    rows = block[i].values
    vectors = rows.field("vector").flatten().to_numpy(zero_copy_only=False).astype(float)
    return tuple(rows.field(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "key")) + (vectors.reshape(len(rows), -1),)


def _tiles(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (q_ids, q_keys, q), (c_ids, _, c) = _unpack(batch.column(0), i), _unpack(batch.column(1), i)
            row, at, score = tile(q, q_ids, c, c_ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[row], q_keys[row], c_ids[at], score)], ["query_id", "query_key", "vec_id", "score"])


#: Heaps that a task keeps before it hands the finished ones on.
HEAPS = 50_000


def _merge(k: int, ranked: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query: a heap for each, the worst of its rows on top.

    Where the rows of a query follow each other, all heaps but the last are finished at any time; where they do not,
    handing them on early only leaves more rows to the next merge.
    """
    heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}

    def emit(keys: list[tuple[int, int]]) -> pa.RecordBatch:
        rows = [(*key, -vec, -score, rank) for key in keys for rank, (score, vec) in enumerate(sorted(heaps.pop(key), reverse=True), 1)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())[: 5 if ranked else 4]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "query_key", "vec_id", "score", "rank"][: len(kinds)])

    for batch in batches:
        key = None
        for query, own, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (query, own)
            heap, row = heaps.setdefault(key, []), (-score, -vec)
            if len(heap) < k:
                heapq.heappush(heap, row)
            elif row > heap[0]:
                heapq.heapreplace(heap, row)
        if len(heaps) > HEAPS:
            yield emit([x for x in heaps if x != key])
    yield emit(list(heaps))


def _pack(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of about ``size`` vectors of one dimension, and how many blocks each dimension has."""
    cuts = rows.groupBy(F.col("dim").alias("c_dim")).agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    dealt = rows.join(cuts, F.col("dim") == F.col("c_dim")).withColumn("block", F.pmod(F.xxhash64("vec_id", "key", F.lit(name)), F.col("n")).cast("int"))
    return dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "key", "vector")).alias(name)), cuts


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of ``vectors`` to each row of ``queries``, by Euclidean distance.

    Both have vec_id and vector columns. Results are exact: the bounds leave no
    true neighbour out, and ties go to the smaller vec_id. Rows equal in id and
    vector are one row; the query itself is no candidate. A vector is compared
    with those of its own length; unusable ones (see ``usable``) and null ids
    take no part, and a query without candidates gives no rows.
    """
    def prepare(df):
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        return rows.select("vec_id", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("key")).dropDuplicates(["vec_id", "key"])

    vectors, cuts = _pack(materialise(prepare(vectors), "vectors"), vector_block, "c")
    queries, _ = _pack(materialise(prepare(queries), "queries"), query_block, "q")
    # Each query block is sent to each candidate block of its dimension.
    sent = queries.join(cuts, F.col("dim") == F.col("c_dim")).select(F.col("dim").alias("q_dim"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q_block"), "q")
    met = sent.join(vectors, (F.col("dim") == F.col("q_dim")) & (F.col("block") == F.col("q_block")))
    found = met.select("q", "c").mapInArrow(partial(_tiles, k), TILE).mapInArrow(partial(_merge, k, False), TILE)
    placed = found.repartition("query_id", "query_key").sortWithinPartitions("query_id", "query_key")
    return placed.mapInArrow(partial(_merge, k, True), f"{TILE}, rank int").select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Searches a table (vec_id, embedding) for the rows whose id ``every`` divides."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.where(F.col("vec_id") % every == 0), k)
