"""Product codes of vectors; codebooks are searched by Orchard's method, in whole numbers.

Each entry of a codebook has a list of all entries by distance from it. A search walks the list of its
best entry so far, passes over entries it has measured, and jumps to the list of any better one. It
stops where the list is beyond twice the best distance: by the triangle inequality nothing behind
can be as near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.session import materialise

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Whole numbers beyond this are set to it, so that distances and their sums over 4,096 components fit 64 bits.
LIMIT = 1 << 24
BLOCK = 4096


class Codebooks(NamedTuple):
    """Entries of each part (part, entry, position); for each entry all entries by distance, and those squared distances."""

    entries: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        apart = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(3)
        order = np.argsort(apart, axis=2, kind="stable")
        return cls(entries, order, np.take_along_axis(apart, order, 2))

    def start(self, x: np.ndarray) -> np.ndarray:
        """For vectors (row, part, position) an entry of a near first component: any one gives the same result, a near one sooner."""
        out = np.empty(x.shape[:2], np.int64)
        for p, book in enumerate(self.entries):
            by = np.argsort(book[:, 0], kind="stable")
            out[:, p] = by[np.minimum(np.searchsorted(book[by, 0], x[:, p, 0]), len(by) - 1)]
        return out

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each part of each row, ties to the lower index; and how many distances were measured."""
        n, parts, width = x.shape
        size = self.entries.shape[1]
        part = np.tile(np.arange(parts), n)
        now, flat = self.start(x).ravel(), x.reshape(-1, width)
        best = ((flat - self.entries[part, now]) ** 2).sum(1)
        seen = np.zeros((len(flat), size), bool)
        seen[np.arange(len(flat)), now] = True
        at, open_, measured = np.zeros(len(flat), np.int64), np.arange(len(flat)), len(flat)
        while len(open_):
            of, list_, k = part[open_], now[open_], at[open_]
            # A tie may lie exactly at twice the distance.
            near = self.apart[of, list_, k] <= 4 * best[open_]
            open_, entry = open_[near], self.order[of, list_, k][near]
            at[open_] += 1
            fresh = ~seen[open_, entry]
            row, entry = open_[fresh], entry[fresh]
            seen[row, entry] = True
            measured += len(row)
            far = ((flat[row] - self.entries[part[row], entry]) ** 2).sum(1)
            better = (far < best[row]) | ((far == best[row]) & (entry < now[row]))
            row, entry = row[better], entry[better]
            now[row], best[row], at[row] = entry, far[better], 0
            open_ = open_[at[open_] < size]
        return now.reshape(n, parts), best.reshape(n, parts), measured

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x * float(SCALE)), -LIMIT, LIMIT).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(2)
        values, size = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
        at = np.append(0, np.cumsum(size)) * 4
        data = pa.py_buffer(whole_numbers(values).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(at.astype(np.int32)), data])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["vec_id", "label", "whole"])


def _blocks(column: pa.Array, parts: int, dim: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``dim`` components: their places, and their vectors (row, part, position)."""
    fits = np.flatnonzero(pc.binary_length(column).to_numpy(zero_copy_only=False) == 4 * dim)
    for k in range(0, len(fits), block):
        row = fits[k : k + block]
        data = b"".join(column.take(pa.array(row)).to_pylist())
        yield row, np.frombuffer(data, np.int32).astype(np.int64).reshape(len(row), parts, -1)


def _sums(books, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sum of the parts of each entry, over a whole task."""
    own = books.value
    parts, size, width = own.entries.shape
    count, total = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64)
    for batch in batches:
        for _, x in _blocks(batch.column(0), parts, parts * width):
            spot = (own.search(x)[0] + np.arange(parts) * size).ravel()
            count += np.bincount(spot, minlength=len(count))
            by = np.argsort(spot, kind="stable")
            first = np.flatnonzero(np.diff(spot[by], prepend=-1))
            total[spot[by][first]] += np.add.reduceat(x.reshape(-1, width)[by], first, axis=0)
    used = np.flatnonzero(count)
    ends = np.arange(len(used) + 1, dtype=np.int32) * width
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.ListArray.from_arrays(pa.array(ends), pa.array(total[used].ravel()))], ["entry", "n", "total"])


def _codes(books, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = books.value
    parts, _, width = own.entries.shape
    for batch in batches:
        code, error = [None] * batch.num_rows, [None] * batch.num_rows
        for row, x in _blocks(batch.column(2), parts, parts * width):
            entry, far, _ = own.search(x)
            for i, digits, far_ in zip(row.tolist(), entry.astype(np.uint8), far.sum(1).tolist(), strict=True):
                code[i], error[i] = digits.tobytes().hex(), far_
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def first_entries(whole: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the smallest ids (ties by their bytes, null ids last) that have the dimension of the first of them; None without vectors."""
    order = [F.col("vec_id").asc_nulls_last(), "whole"]
    fits = whole.where((F.length("whole") > 0) & (F.length("whole") % (4 * parts) == 0))
    head = fits.orderBy(*order).first()
    if head is None:
        return None
    rows = fits.where(F.length("whole") == len(head["whole"])).orderBy(*order).limit(entries).collect()
    return np.stack([np.frombuffer(r["whole"], np.int32).astype(np.int64).reshape(parts, -1) for r in rows], 1)


def train(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Rounds of assigning every part to its nearest entry and moving entries to the mean of their parts, rounded down; unused ones stay.

    What comes back to the driver is one sum for each entry, whatever the number of vectors.
    """
    began = first_entries(whole, parts, entries)
    if began is None:
        return None
    books, context = Codebooks.of(began), whole.sparkSession.sparkContext
    width = began.shape[2]
    for _ in range(rounds):
        found = whole.select("whole").mapInArrow(partial(_sums, context.broadcast(books)), "entry long, n long, total array<long>")
        sums = found.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(k))).alias(f"s{k}") for k in range(width)])
        moved = books.entries.reshape(-1, width).copy()
        for r in sums.collect():  # at most parts x entries rows
            moved[r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
        books = Codebooks.of(moved.reshape(books.entries.shape))
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable row of (vec_id, label, vector).

    ``entries`` is at most 256. Components become floor(256 x), at most 2**24 in size. All vectors share the
    dimension of the smallest id whose length ``parts`` divides; one of another length keeps its row with a null code and error.
    With fewer vectors than entries the codebooks are as short. Rows of equal ids are rows of their own; null ids come
    last among the first entries; null labels are one label; an empty table gives no rows; other columns are not read.
    label_error is null where a sum passes 64 bits.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    kind = rows.schema["label"].dataType.simpleString()
    whole = materialise(rows.mapInArrow(_whole, f"vec_id long, label {kind}, whole binary"), "whole")
    books = train(whole, parts, entries, rounds)
    if books is None:
        return whole.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    sent = whole.sparkSession.sparkContext.broadcast(books)
    coded = materialise(whole.mapInArrow(partial(_codes, sent), f"vec_id long, label {kind}, code string, error long"), "coded")
    # Written, so that the rows of a large label can be split when the sums are joined.
    sums = materialise(coded.groupBy(F.col("label").alias("_of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_of"))).drop("_of").withColumn("codebooks_sha256", F.lit(books.digest()))
