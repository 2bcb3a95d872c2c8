"""Best-two-fit packing of token sequences into bins of a fixed size.

Documents matter to packing only by their lengths, and there are at most
``room`` different lengths. So the plan is made on the histogram of lengths, as
bin patterns with a number of repeats, and the pieces are then dealt to the
pattern's places by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatloom.llm.tokens import END_ID, WIDTH, default_tokenizer, encoder
from heatloom.session import materialise

ROOM = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut where longer than ``room``.

    Only the first piece may be shorter. A null text is empty and leaves the end id alone.
    """
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(WIDTH, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // WIDTH
                edges = [0, *range(n % room or room, n + 1, room)] if n > room else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a * WIDTH : b * WIDTH])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def best_two_fit(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, dict[int, int]]]:
    """Bin patterns (repeats, count of each length) that use up the histogram.

    A bin is filled greedily with the longest pieces that still fit. Then its
    shortest piece gives way to two unpacked pieces if they fill the widened gap
    more tightly. A pattern repeats for as long as the lengths it takes last,
    so the number of patterns depends on ``room``, not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    patterns = []
    while lengths:
        bin_: dict[int, int] = {}
        gap, top = room, len(lengths)
        while top and gap:
            top = bisect_right(lengths, gap, 0, top)
            if top:
                n = lengths[top - 1]
                take = min(gap // n, left[n])
                bin_[n] = take
                gap, top = gap - take * n, top - 1
        _replace_smallest(bin_, gap, left, lengths)
        times = min(left[n] // c for n, c in bin_.items())
        patterns.append((times, bin_))
        for n, c in bin_.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]]
    return patterns


def _replace_smallest(bin_: dict[int, int], gap: int, left: dict[int, int], lengths: list[int]) -> None:
    small = min(bin_)
    if not gap or len(bin_) == 1 and bin_[small] == 1:
        return
    wide, best = gap + small, (small, None)
    spare = lambda n: left[n] - bin_.get(n, 0)
    for a in lengths[: bisect_right(lengths, wide - 1)]:
        if spare(a) <= 0:
            continue
        k = bisect_right(lengths, wide - a)
        # The longest other length that fits; it may need to be a second piece of the first.
        while k and (lengths[k - 1] == small or spare(lengths[k - 1]) < 1 + (lengths[k - 1] == a)):
            k -= 1
        if k and a != small and a + lengths[k - 1] > best[0]:
            best = (a + lengths[k - 1], (a, lengths[k - 1]))
    if best[1]:
        bin_[small] -= 1
        if not bin_[small]:
            del bin_[small]
        for n in best[1]:
            bin_[n] = bin_.get(n, 0) + 1


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces in a sequence, offset of the first of them)."""
    rows, used, sequence = [], {}, 0
    for times, bin_ in patterns:
        offset = 0
        for n, c in sorted(bin_.items(), reverse=True):
            rows.append((n, used.get(n, 0), used.get(n, 0) + times * c, sequence, c, offset))
            used[n] = used.get(n, 0) + times * c
            offset += n * c
        sequence += times
    return rows


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``room`` tokens.

    Pieces of one length may be a third of all rows, so they are numbered in
    salted groups, by (length, salt), and the groups' sizes added up in front.
    Equal rows get places of their own. No piece gives no row.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = materialise(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    sizes = materialise(pieces.groupBy("length", "_salt").count(), "sizes")
    # At most ``room`` rows reach the driver, whatever the number of pieces.
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = places(best_two_fit(histogram, room))
    slots = spark.createDataFrame(plan, "_length int, _low long, _high long, _sequence long, _each long, _offset long")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("_within", within)
    ranked = ranked.join(starts, (ranked["length"] == starts["_l"]) & (ranked["_salt"] == starts["_s"])).withColumn("_rank", F.col("_before") + F.col("_within"))
    # Each length has fewer places than room / length patterns with that count: some 8,000 rows at 1024.
    fits = (ranked["length"] == slots["_length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    at = F.col("_rank") - F.col("_low")
    return ranked.join(F.broadcast(slots), fits).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``room`` tokens."""
    return pack(cut(docs, tokenizer, room), room)
