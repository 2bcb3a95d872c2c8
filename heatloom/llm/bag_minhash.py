"""Near-duplicate documents by weighted-Jaccard signatures of their bags of word shingles.

A shingle of count w owns a Poisson process over time and the weights below w.
The weights are cut into the dyadic intervals (0,1], (1,2], (2,4], ...; each has
a process of its own, which after its first point splits into its two halves,
and so on down to single weights. All processes are fixed by the shingle's hash
alone, so bags share exactly the points below their common weight: each
component, the earliest point dealt to it, is equal in two bags with a
probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm import text
from heatloom.llm.graph import components
from heatloom.llm.span_dedup import text_key
from heatloom.session import materialise

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _points(element, low, size, turn, components):
    """Waiting time, component and weight of the next point of each process. Twice its middle tells an interval from all others."""
    middle = (low << np.uint64(1)) + size
    seed = text.mix(element ^ text.mix((middle << np.uint64(24)) + turn + np.uint64(1)))
    wait = -np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / size
    other = text.mix(seed + _GOLDEN)
    component = ((other >> np.uint64(32)) * np.uint64(components)) >> np.uint64(32)
    weight = low + (((other & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32))
    return wait, component.astype(np.int64), weight


def signatures(bags: text.Shingles, rows: int, components: int = BANDS * ROWS) -> np.ndarray:
    """Time of the earliest point of each component, by row; infinite for an empty bag. Counts are below 2**32: no text has more words."""
    least = np.full((rows, components), np.inf)
    # The dyadic intervals that begin below the count.
    most = int(bags.count.max()) if len(bags.count) else 0
    levels = [(np.uint64(0), np.uint64(1))] + [(np.uint64(1 << k), np.uint64(1 << k)) for k in range(max(0, most - 1).bit_length())]
    parts = [np.flatnonzero(bags.count > int(low)) for low, _ in levels]
    of = np.concatenate(parts)
    low = np.repeat(np.array([x[0] for x in levels]), [len(p) for p in parts])
    size = np.repeat(np.array([x[1] for x in levels]), [len(p) for p in parts])
    time, turn = np.zeros(len(of)), np.zeros(len(of), np.uint64)
    limit = np.full(rows, np.inf)
    while len(of):
        wait, component, weight = _points(bags.hash[of], low, size, turn, components)
        time = time + wait
        row = bags.row[of]
        soon = time <= limit[row]
        of, low, size, turn, time, component, weight, row = (a[soon] for a in (of, low, size, turn, time, component, weight, row))
        inside = weight < bags.count[of].astype(np.uint64)
        np.minimum.at(least, (row[inside], component[inside]), time[inside])
        limit = least.max(1)
        # A single weight goes on; an interval leaves the rest to its halves.
        single = size == 1
        half = size[~single] >> np.uint64(1)
        upper = low[~single] + half
        begun = upper < bags.count[of[~single]].astype(np.uint64)
        of = np.concatenate([of[single], of[~single], of[~single][begun]])
        low = np.concatenate([low[single], low[~single], upper[begun]])
        size = np.concatenate([size[single], half, half[begun]])
        time = np.concatenate([time[single], time[~single], time[~single][begun]])
        turn = np.concatenate([turn[single] + np.uint64(1), np.zeros(len(half) + begun.sum(), np.uint64)])
    return least


def similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard similarity of two bags {shingle: count}; 0 if one is empty."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


def bands(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash of each band's components, told apart by the band's number."""
    bits = least.view(np.uint64)
    out = []
    for k in range(bits.shape[1] // rows):
        h = np.full(len(bits), k + 1, np.uint64)
        for j in range(rows):
            h = text.mix(h * _GOLDEN + bits[:, k * rows + j])
        out.append(h)
    return np.stack(out, 1)


SIGNED = "id long, key long, bag long, n_bytes long, bands array<long>"


def _sign(shingle: int, n_bands: int, n_rows: int, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with a hash of its bag (null without words) and its bands."""
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(1))
        for lo, hi in text.blocks(offsets, block):
            at = offsets[lo : hi + 1] - offsets[lo]
            bags = text.shingles(text.words(data[offsets[lo] : offsets[hi]], at), hi - lo, shingle)
            whole = np.zeros(hi - lo, np.uint64)
            np.add.at(whole, bags.row, text.mix(bags.hash ^ text.mix(bags.count.astype(np.uint64))))
            some = np.bincount(bags.row, minlength=hi - lo) > 0
            own = bands(signatures(bags, hi - lo, n_bands * n_rows), n_rows)
            ends = np.arange(hi - lo + 1, dtype=np.int32) * n_bands
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(whole.view(np.int64), mask=~some), pa.array(np.diff(at)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel().view(np.int64))),
            ], ["id", "key", "bag", "n_bytes", "bands"])


def link(bags: text.Shingles, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join all rows whose exact similarity reaches the threshold, directly or by others.

    A breadth-first search over the rows not yet joined: each row found is
    compared with those alone, by adding up the smaller counts of its shingles.
    """
    total = np.bincount(bags.row, bags.count, rows).astype(np.int64)
    first = np.searchsorted(bags.row, np.arange(rows + 1))
    _, column = np.unique(bags.hash, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, count, at = bags.row[order], bags.count[order], column[order]
    free, need = np.ones(rows, bool), round(threshold * 10_000)
    listed, a, b = rows, [], []
    start = np.searchsorted(at, np.arange(len(column) + 1))
    for seed in range(rows):
        if not free[seed]:
            continue
        free[seed] = False
        stack = [seed]
        while stack:
            left = int(free.sum())
            if not left:
                break
            if left < 0.7 * listed:  # forget the rows that are joined
                keep = free[row]
                row, count, at, listed = row[keep], count[keep], at[keep], left
                start = np.searchsorted(at, np.arange(len(column) + 1))
            x = stack.pop()
            own = column[first[x] : first[x + 1]]
            begin, size = start[own], start[own + 1] - start[own]
            spot = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both = np.bincount(row[spot], np.minimum(count[spot], np.repeat(bags.count[first[x] : first[x + 1]], size)), rows).astype(np.int64)
            found = np.flatnonzero(free & (both > 0) & (10_000 * both >= need * (total + total[x] - both)))
            free[found] = False
            stack += found.tolist()
            a.append(np.full(len(found), x))
            b.append(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _verify(shingle: int, threshold: float, table: pa.Table) -> pa.Table:
    """From the (bag, text) rows of two blocks: links that hold them together."""
    data, offsets = text.text_bytes(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    bags = text.shingles(text.words(data, offsets), table.num_rows, shingle)
    a, b = link(bags, table.num_rows, threshold)
    bag = table.column("bag").combine_chunks()
    return pa.table({"a": bag.take(pa.array(a)), "b": bag.take(pa.array(b))})


BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 2048


def near_groups(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, n_bands: int = BANDS, n_rows: int = ROWS, block: int = 1 << 20) -> DataFrame:
    """Per row of ``docs``: id, key (hash of the text) and group, equal for all near duplicates.

    Texts are alike if the bags of their runs of ``shingle`` words reach a
    weighted Jaccard similarity of ``threshold``; groups are the connected
    parts. A pair at 0.8 shares no band with a probability of 3e-7. Texts with
    equal bags are one class from the start, so copies cost nothing further.
    Classes that share a band are joined to the band's first class; within the
    connected parts of that graph every pair that a link could add is compared
    exactly, in pairs of blocks of bounded bytes, of which only joining links
    come out. A text without words (null, empty) is in no group: null. Repeated
    rows are alike; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    signed = materialise(rows.mapInArrow(partial(_sign, shingle, n_bands, n_rows, block), SIGNED), "signed")
    low = F.coalesce("id", F.lit(-(1 << 63)))
    classes = signed.where("bag is not null").groupBy("bag").agg(
        F.min(F.struct(low.alias("low"), "id", "key")).alias("r"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands")
    )
    classes = materialise(classes.select("bag", "r.id", "r.key", "n_bytes", "bands"), "classes")
    banded = classes.select("bag", F.explode("bands").alias("band"))
    hubs = banded.groupBy(F.col("band").alias("hub_band")).agg(F.min("bag").alias("a"), F.max("bag").alias("last")).where("a != last").drop("last")
    parts = components(banded.join(hubs, F.col("band") == F.col("hub_band")).where("bag != a").select("a", F.col("bag").alias("b")))
    members = materialise(classes.select("bag", "id", "key", "n_bytes").join(parts, F.col("bag") == F.col("node")).drop("node"), "members")
    cuts = members.groupBy(F.col("label").alias("part")).agg(
        F.ceil(F.greatest(F.sum("n_bytes") / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)).cast("int").alias("n_blocks")
    )
    dealt = members.join(cuts, F.col("label") == F.col("part")).withColumn("_block", F.pmod(F.xxhash64("bag"), F.col("n_blocks")).cast("int"))
    texts = dealt.select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "bag", "part", "n_blocks", "_block")
    # The members grow with the corpus: no broadcast, not even of a small table's.
    texts = rows.join(texts.hint("merge"), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key"))).dropDuplicates(["bag"])
    # A block meets each other one, so a part of n blocks is sent n times.
    met = texts.select("bag", "part", "text", "_block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("_other"))
    met = met.select("bag", "part", "text", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))

    def verify(table: pa.Table) -> pa.Table:
        return _verify(shingle, threshold, table)

    found = met.groupBy("part", "_i", "_j").applyInArrow(verify, "a long, b long")
    groups = components(found)
    own = signed.select("id", "key", "bag")
    return own.join(groups, F.col("bag") == F.col("node"), "left").select("id", "key", F.coalesce("label", "bag").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, group_id (its smallest doc_id), group_size (rows) and keep (one row id and text of the group).

    A row without words is a group by itself and kept; null ids count as the smallest.
    """
    grouped = materialise(near_groups(docs), "groups")
    low = F.coalesce("id", F.lit(-(1 << 63)))
    heads = grouped.where("group is not null").groupBy(F.col("group").alias("head_of")).agg(F.count("*").alias("group_size"), F.min(F.struct(low.alias("low"), "id", "key")).alias("head"))
    # Written, so that a large group's rows can be split when they are joined.
    joined = grouped.join(materialise(heads, "heads"), F.col("group") == F.col("head_of"), "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("group_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key")))).alias("keep"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns; rows without words all stay."""
    grouped = materialise(near_groups(docs), "groups").where("group is not null")
    low = F.coalesce("id", F.lit(-(1 << 63)))
    heads = grouped.groupBy(F.col("group").alias("head_of")).agg(F.min(F.struct(low.alias("low"), "id", "key")).alias("head"))
    # Rows equal in id and text are told apart by nothing: one of them stays.
    lost = grouped.join(heads, F.col("group") == F.col("head_of")).where(~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))))
    twice = grouped.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    out = lost.select("id", "key", F.lit(False).alias("again")).unionByName(twice.select("id", "key", F.lit(True).alias("again")))
    out = out.groupBy(F.col("id").alias("_lost_id"), F.col("key").alias("_lost_key")).agg(F.min("again").alias("_again"))
    joined = docs.join(out, docs["doc_id"].cast("long").eqNullSafe(out["_lost_id"]) & (text_key(docs["text"]) == out["_lost_key"]), "left")
    columns = [docs[c] for c in docs.columns]
    single = joined.where(out["_lost_key"].isNull()).select(*columns)
    repeated = joined.where(out["_again"]).select(out["_lost_id"], out["_lost_key"], F.struct(*columns).alias("_row"))
    repeated = repeated.groupBy("_lost_id", "_lost_key").agg(F.first("_row").alias("_row"))
    return single.unionByName(repeated.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))
