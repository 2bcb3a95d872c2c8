"""Removes every byte covered by a long string that also starts elsewhere.

The smallest hashed run of bytes in each window of ``length`` bytes is its
anchor. Equal windows have equal anchors, so the windows of one anchor form a
stretch, and a repeated window lies in two stretches with one anchor hash.
Equal stretches are one class from the start. Only the distinct stretches of a
shared anchor are indexed: their suffixes are sorted, and intervals of the
Burrows-Wheeler transform are extended backwards, breadth first, one byte a
round. A round derives the common prefixes of its length, so after the round
``length`` the places still open are those where neighbours share a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm import text
from heatloom.llm.span_dedup import text_key
from heatloom.session import materialise

LENGTH, RUN, SECTION = 400, 64, 1 << 22
BLOCK_BYTES = 1 << 20


def _run_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every RUN bytes, a power of two from 8 on, by doubling."""
    x = data.astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        x = x[:-step] | (x[step:] << np.uint64(shift))
    x, step = text.mix(x), 8
    while step < RUN:
        x, step = text.mix(x[:-step] * np.uint64(0x9E3779B97F4A7C15) + x[step:]), 2 * step
    return x


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Place of the anchor of each window: its run of bytes with the smallest hash, the leftmost if equal."""
    own = _run_hashes(data)
    span = length - RUN + 1
    # 40 bits of the hash and the place, so that one minimum gives both.
    packed = (own >> np.uint64(24) << np.uint64(24)) | (np.arange(len(own), dtype=np.uint64) & np.uint64(0xFFFFFF))
    width = 1
    while width * 2 <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    rest = span - width
    if rest:
        packed = np.minimum(packed[:-rest], packed[rest:])
    place = np.arange(len(packed))
    return place + ((packed.astype(np.int64) - place) & 0xFFFFFF)


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each stretch of one text.

    A long text is taken in sections, which may cut a stretch in two.
    """
    first, windows, anchor = [], [], []
    for begin in range(0, len(data) - length + 1, SECTION):
        part = data[begin : begin + SECTION + length - 1]
        at = anchors(part, length)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        first.append(begin + new)
        windows.append(np.diff(np.append(new, len(at))))
        anchor.append(_run_hashes(part)[at[new]])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(first), np.concatenate(windows), np.concatenate(anchor)


STRETCHES = "id long, key long, anchor long, class long, first int, windows int"


def _stretches(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(1))
        for lo, hi in text.blocks(offsets, 1 << 20):
            row, first, windows, anchor, whole = [], [], [], [], []
            for r in range(lo, hi):
                own = np.ascontiguousarray(data[offsets[r] : offsets[r + 1]])
                f, n, a = stretches(own, length)
                view = memoryview(own)
                whole += [xxhash.xxh3_64_intdigest(view[i : i + m + length - 1]) for i, m in zip(f.tolist(), n.tolist(), strict=True)]
                row.append(np.full(len(f), r))
                first.append(f)
                windows.append(n)
                anchor.append(a)
            rows = pa.array(np.concatenate(row))
            ints = lambda parts: pa.array(np.concatenate(parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(2).take(rows), pa.array(np.concatenate(anchor).view(np.int64)),
                pa.array(np.array(whole, np.uint64).view(np.int64)), ints(first), ints(windows),
            ], ["id", "key", "anchor", "class", "first", "windows"])


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by doubling the compared length."""
    n = len(symbols)
    # Seven symbols of nine bits in one number to begin with.
    done = 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(done, np.int64)])
    rank = np.zeros(n, np.int64)
    for k in range(done):
        rank = rank << 9 | padded[k : k + n]
    order = np.argsort(rank)
    while True:
        sorted_rank = rank[order]
        new = np.ones(n, np.int64)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new)
        if done >= depth or int(dense[order[-1]]) == n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - done] = dense[done:]
        rank = dense * (n + 1) + after
        order = np.argsort(rank)
        done *= 2


class Transform:
    """Burrows-Wheeler transform with ranks of its symbols, by a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray):
        self.n, self.bits = len(symbols), max(1, int(symbols.max()).bit_length())
        sequence = symbols[order - 1]  # the symbol before each suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])
        self.ones, self.zeros = [], []
        for bit in reversed(range(self.bits)):
            one = (sequence >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            self.zeros.append(self.n - int(one.sum()))
            sequence = np.concatenate([sequence[one == 0], sequence[one == 1]])

    def extend(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of all one-symbol extensions to the left of the strings of the given intervals."""
        symbol = np.zeros(len(low), np.int64)
        base = np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a, b, c = ones[low], ones[high], ones[base]
            left, right = np.flatnonzero(high - b > low - a), np.flatnonzero(b > a)
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            low, high, base = (
                np.concatenate([(x - y)[left], zeros + y[right].astype(np.int64)]) for x, y in ((low, a), (high, b), (base, c))
            )
        start = self.before[symbol] - base
        return start + low, start + high


def shared(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order after the first: whether the suffix there and the one before share ``length`` symbols.

    Round by round, the common prefix of the round's length is settled at the
    end of every interval that is new. An interval whose end is settled before
    has nothing to add, so each place is looked at once.
    """
    transform = Transform(symbols, order)
    n = len(symbols)
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        low, high = transform.extend(low, high)
        # Common prefixes of this round's length: where an interval ends at an open place.
        new = open_[high]
        low, high = low[new], high[new]
        open_[high] = False
        if not len(low):
            break
    return open_[:n]


def _fetch(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, wanted stretches): a row of each stretch with its bytes."""
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(0))
        lists = batch.column(1)
        ends, rows = lists.offsets.to_numpy(), lists.flatten()
        for lo, hi in text.blocks(offsets, 1 << 21):
            own = rows.slice(ends[lo], ends[hi] - ends[lo])
            start = np.repeat(offsets[lo:hi], np.diff(ends[lo : hi + 1])) + own.field("first").to_numpy()
            stop = start + own.field("windows").to_numpy() + length - 1
            got = pa.array([bytes(data[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
            names = ["anchor", "class", "windows", "n_blocks"]
            yield pa.RecordBatch.from_arrays([*map(own.field, names), got], [*names, "bytes"])


def repeated_windows(parts: list[bytes], windows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part: the runs (first, number) of its windows that also start in another place of the parts."""
    size = np.array([len(p) for p in parts])
    # 0 ends the whole, 1 each part, and a byte is itself plus 2.
    symbols = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 2
    begin = np.cumsum(size + 1) - size - 1
    symbols[begin + size] = 1
    symbols = np.append(symbols, np.int16(0))
    order = suffix_order(symbols, length)
    same = shared(symbols, order, length)
    again = np.zeros(len(symbols) + 1, bool)
    again[order[1:][same[1:]]] = True
    again[order[:-1][same[1:]]] = True
    out = []
    for at, n in zip(begin.tolist(), windows.tolist(), strict=True):
        own = np.concatenate([[False], again[at : at + n], [False]])
        edge = np.flatnonzero(own[1:] != own[:-1])
        out.append(np.stack([edge[::2], edge[1::2] - edge[::2]], 1).ravel())
    return out


def _index(length: int, table: pa.Table) -> pa.Table:
    """From the distinct stretches of some anchors: those with repeated windows, and which."""
    table = table.combine_chunks()
    runs = repeated_windows(table.column("bytes").to_pylist(), table.column("windows").to_numpy(), length) if table.num_rows else []
    some = np.flatnonzero([len(r) for r in runs]) if runs else np.zeros(0, np.int64)
    lists = pa.array([runs[k].astype(np.int32) for k in some], pa.list_(pa.int32()))
    which = pa.array(some)
    return pa.table({"anchor": table.column("anchor").take(which), "class": table.column("class").take(which), "runs": lists})


def _cut(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, spans (first byte, bytes), ...): what is left, and the merged spans."""
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(0))
        lists = batch.column(1)
        kept, removed, merged = [], [], []
        for k in range(batch.num_rows):
            own = data[offsets[k] : offsets[k + 1]]
            spans = lists[k].values
            if spans is None or not len(spans):
                kept.append(own.tobytes())
                removed.append(0)
                merged.append([])
                continue
            first = spans.field("first").to_numpy()
            step = np.zeros(len(own) + 1, np.int32)
            np.add.at(step, first, 1)
            np.add.at(step, first + spans.field("size").to_numpy(), -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept.append(own[~gone].tobytes())
            removed.append(int(gone.sum()))
            merged.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(merged, kind), *batch.columns[2:]],
            ["kept", "n_bytes", "n_removed", "spans", *names],
        )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, key (hash of the text) and the byte spans (first, size) that repeated strings of ``length`` bytes cover."""
    rows = _rows(docs)
    every = materialise(rows.mapInArrow(partial(_stretches, length), STRETCHES), "stretches")
    again = every.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("a")
    again = materialise(again, "anchors")  # a join by itself may split a frequent anchor's rows
    found = materialise(every.join(again, F.col("anchor") == F.col("a")).drop("a"), "shared")
    classes = materialise(
        found.groupBy("anchor", "class").agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.min(F.struct("id", "key", "first")).alias("r")), "classes"
    )
    # Anchors with several distinct stretches are indexed, one copy of each stretch.
    mixed = classes.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("n_classes"), F.sum(F.col("windows") + (length - 1)).alias("n_bytes")).where("n_classes > 1")
    mixed = materialise(mixed.withColumn("n_blocks", F.ceil(F.col("n_bytes") / BLOCK_BYTES).cast("int")), "mixed")
    total = mixed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = 1 + total // BLOCK_BYTES
    wanted = classes.join(mixed, F.col("anchor") == F.col("a")).groupBy(F.col("r.id").alias("w_id"), F.col("r.key").alias("w_key")).agg(
        F.collect_list(F.struct("anchor", "class", F.col("r.first").alias("first"), "windows", "n_blocks")).alias("wanted")
    )
    fetched = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("text", "wanted")
    dealt = fetched.mapInArrow(partial(_fetch, length), "anchor long, class long, windows int, n_blocks int, bytes binary")
    # Small anchors share a bucket. One beyond a block is cut up, and each of its blocks meets each other one.
    mine = F.pmod(F.xxhash64("class"), F.col("n_blocks")).cast("int")
    met = dealt.select(
        F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("anchor"), F.lit(buckets))).otherwise(F.col("anchor")).alias("_group"),
        F.col("n_blocks").alias("_n"), mine.alias("_mine"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("_other"), "anchor", "class", "windows", "bytes",
    ).withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")})

    def index(table: pa.Table) -> pa.Table:
        return _index(length, table)

    marked = met.groupBy("_group", "_n", "_i", "_j").applyInArrow(index, "anchor long, class long, runs array<int>")
    marked = marked.groupBy("anchor", "class").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    # A stretch that occurs twice is covered as a whole, any other as its marks say.
    whole = classes.where("n > 1").select("anchor", "class", F.array(F.lit(0), F.col("windows")).alias("runs"))
    single = classes.where("n = 1").select(F.col("anchor").alias("s_anchor"), F.col("class").alias("s_class"))
    marked = marked.join(single, (F.col("anchor") == F.col("s_anchor")) & (F.col("class") == F.col("s_class"))).select("anchor", "class", "runs")
    marks = whole.unionByName(marked).select(F.col("anchor").alias("m_anchor"), F.col("class").alias("m_class"), "runs")
    spans = found.join(marks, (F.col("anchor") == F.col("m_anchor")) & (F.col("class") == F.col("m_class"))).select(
        "id", "key",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)),
            lambda k: F.struct((F.col("first") + F.get("runs", k)).alias("first"), (F.get("runs", k + 1) + (length - 1)).alias("size")),
        )).alias("span"),
    )
    return spans.groupBy("id", "key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """kept (bytes), n_bytes, n_removed and spans (start, end; merged) of every row, with doc_id.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else too, in the same text or another one; strings are judged on the input.
    A null text is empty; texts shorter than ``length`` stay whole; an empty
    table gives no rows; other columns are not read. Equal rows count as two
    places. Stretches are told apart by 64-bit hashes of them and their anchor.
    """
    spans = repeated_spans(docs, length).select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), "spans")
    # Dealt out like the rows that the indexed stretches are fetched from, so both joins use one exchange.
    joined = _rows(docs).join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left").select("text", "spans", F.col("id").alias("doc_id"))
    ddl = "kept binary, n_bytes long, n_removed long, spans array<struct<start long, end long>>, doc_id long"
    return joined.mapInArrow(partial(_cut, ["doc_id"]), ddl)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return remove_repeats(docs, length).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
