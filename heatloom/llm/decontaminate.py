"""Benchmark decontamination by winnowed fingerprints.

Of every ``window`` consecutive words, the smallest hash among its runs of
``gram`` words is kept. Equal windows keep equal runs, so a shared window always
shows as a shared fingerprint. Documents and benchmark are joined on those, and
each hit is extended over the words on both sides to see the whole window.
Benchmark items shorter than a window are fingerprints as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm import text
from heatloom.session import materialise

WINDOW, GRAM, SLOTS = 13, 7, 1 << 22
FINGERPRINTS = {
    "rid": pa.int64(), "id": pa.int64(), "key": pa.int64(), "n_words": pa.int64(), "kind": pa.int32(), "fingerprint": pa.int64(),
    "at": pa.int32(), "around": pa.binary(),
}
_DDL = "rid long, id long, key long, n_words long, kind int, fingerprint long, at int, around binary"


def _around(hashes: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The words of every window that holds the run, one row each; 0 beyond the text."""
    side = window - gram
    padded = np.concatenate([np.zeros(side, np.uint64), hashes, np.zeros(side, np.uint64)])
    return padded[at[:, None] + np.arange(2 * side + gram)]


def _fingerprints(window: int, gram: int, lengths: tuple[int, ...] | None, wanted, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of kind 0 for each text, then its fingerprints of kind ``window`` or of a shorter item's length.

    lengths: of the short items to look for; None: the texts are the items.
    """
    wanted = wanted.value if wanted is not None else None
    serial = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(1))
        ids, keys = batch.column(0), batch.column(2)
        for lo, hi in text.blocks(offsets, block):
            found = text.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            size = np.bincount(found.row, minlength=hi - lo)
            first = np.cumsum(size) - size
            row, kind, fingerprint, at, around = [np.arange(hi - lo)], [np.zeros(hi - lo, np.int32)], [np.zeros(hi - lo, np.uint64)], [np.zeros(hi - lo, np.int64)], [b""] * (hi - lo)
            kinds = range(1, window) if lengths is None else lengths
            for n in kinds:
                spot = np.arange(len(found.hash) - n + 1) if lengths is not None else first[size == n]
                hashes = text.grams(found.hash, n)
                own = text.mix(hashes[spot] + np.uint64(n))
                keep = found.row[spot] == found.row[spot + n - 1] if len(spot) else np.zeros(0, bool)
                _add(found, spot[keep], own[keep], n, first, wanted, row, kind, fingerprint, at, around, None)
            # Windows over two texts are no windows: runs are winnowed for each text.
            spot = winnow(found, window, gram)
            own = text.mix(text.grams(found.hash, gram)[spot] + np.uint64(window)) if len(spot) else np.zeros(0, np.uint64)
            _add(found, spot, own, window, first, wanted, row, kind, fingerprint, at, around, (first, size, gram))
            rows = np.concatenate(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(serial + rows), ids.slice(lo, hi - lo).take(pa.array(rows)), keys.slice(lo, hi - lo).take(pa.array(rows)), pa.array(size[rows].astype(np.int64)),
                pa.array(np.concatenate(kind)), pa.array(np.concatenate(fingerprint).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(around, pa.binary()),
            ], list(FINGERPRINTS))
            serial += hi - lo


def winnow(found: text.Words, window: int, gram: int) -> np.ndarray:
    """Positions of the runs of ``gram`` words with the smallest hash, the leftmost if equal, in some window of one text."""
    own = text.grams(found.hash, gram)
    span = window - gram + 1
    n = len(own) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = own[:n].copy(), np.arange(n)
    for j in range(1, span):
        less = np.flatnonzero(own[j : j + n] < least)
        least[less] = own[j + less]
        at[less] = less + j
    return np.unique(at[found.row[:n] == found.row[window - 1 : window - 1 + n]])


def _add(found, spot, own, n, first, wanted, row, kind, fingerprint, at, around, sides) -> None:
    if wanted is not None:
        slot = (own & np.uint64(SLOTS - 1)).astype(np.int64)
        keep = (wanted[slot >> 3] >> (slot & 7)) & 1 == 1
        spot, own = spot[keep], own[keep]
    if not len(spot):
        return
    row.append(found.row[spot])
    kind.append(np.full(len(spot), n, np.int32))
    fingerprint.append(own)
    at.append(spot - first[found.row[spot]])
    if sides is None:
        around += [b""] * len(spot)
        return
    begin, size, gram = sides
    words = _around(found.hash, spot, n, gram)
    place = spot[:, None] + np.arange(-(n - gram), n) - begin[found.row[spot]][:, None]
    words[(place < 0) | (place >= size[found.row[spot]][:, None])] = 0
    around += [w.tobytes() for w in words]


def _extend(window: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (rid, items, kind, at, around of both): the run of equal words, if it holds a window."""
    side = window - gram
    width = 2 * side + gram
    for batch in batches:
        kind, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
        start, end = at.copy(), at + kind
        long = np.flatnonzero(kind == window)
        if len(long):
            pair = [np.frombuffer(b"".join(batch.column(i).take(pa.array(long)).to_pylist()), "<u8").reshape(-1, width) for i in (4, 5)]
            same = (pair[0] == pair[1]) & (pair[0] != 0)
            left = np.minimum.accumulate(same[:, side - 1 :: -1], axis=1).sum(1) if side else 0
            right = np.minimum.accumulate(same[:, side + gram :], axis=1).sum(1) if side else 0
            start[long], end[long] = at[long] - left, at[long] + gram + right
            end[long[~same[:, side : side + gram].all(1)]] = 0
        keep = np.flatnonzero((kind != window) | (end - start >= window))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32))],
            ["rid", "items", "first", "last"],
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = 1 << 19) -> DataFrame:
    """Per document: doc_id, key (hash of the text), n_words, n_hit, items (ids as sorted strings).

    A word is hit if it lies in an occurrence of a window of a benchmark item:
    ``window`` consecutive words, or the whole of a shorter item that has words.
    A null or empty text has no words and no hits; a null item id counts as an
    item named "null". Repeated documents each get their row, repeated items and
    items with equal words are all named. Without items nothing is hit; other
    columns are not read.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    narrow = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    tasks = partial(_fingerprints, window, gram)
    items = materialise(narrow(benchmark, "item_id").mapInArrow(partial(tasks, None, None, block), _DDL).where("kind > 0"), "items")
    # At most ``window`` lengths and SLOTS bits, whatever the number of items.
    lengths = tuple(sorted(r[0] for r in items.where(F.col("kind") < window).select("kind").distinct().collect()))
    slot = F.col("fingerprint").bitwiseAND(F.lit(SLOTS - 1))
    filled = np.zeros(SLOTS // 8, np.uint8)
    bits = items.groupBy(F.shiftright(slot, 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(fingerprint & 7 as int))")).alias("bits"))
    for r in bits.collect():
        filled[r["byte"]] = r["bits"]
    wanted = spark.sparkContext.broadcast(filled)
    found = materialise(narrow(docs, "doc_id").mapInArrow(partial(tasks, lengths, wanted, block), _DDL), "fingerprints")
    # Equal surroundings once, with all their items.
    index = items.groupBy("kind", "fingerprint", "around").agg(F.collect_set(F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("items"))
    index = index.select(*(F.col(c).alias(f"i_{c}") for c in ("kind", "fingerprint", "around")), "items")
    hits = found.where("kind > 0").join(index, (F.col("fingerprint") == F.col("i_fingerprint")) & (F.col("kind") == F.col("i_kind")))
    runs = hits.select("rid", "items", "kind", "at", "around", "i_around").mapInArrow(partial(_extend, window, gram), "rid long, items array<string>, first int, last int")
    # The runs of a document are merged in order: words covered by any of them.
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["last"] - F.greatest(s["first"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["last"]).alias("upto")),
    )["n"]
    per = runs.groupBy(F.col("rid").alias("hit_rid")).agg(
        F.collect_set(F.struct("first", "last")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    per = per.select("hit_rid", merged.cast("long").alias("n_hit"), "items")
    base = found.where("kind = 0").select("rid", F.col("id").alias("doc_id"), "key", "n_words")
    return base.join(per, base["rid"] == per["hit_rid"], "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated(n_hit, n_words):
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of find_contamination()."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = find_contamination(docs, benchmark).where(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (key == bad["_bad_key"]), "left_anti")
