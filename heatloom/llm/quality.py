"""A quality score by histogram gradient-boosted trees over statistics of a document's text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm import text

THRESHOLD = 0.7
#: Labelled rows that a model is fitted on, at most (expected number; rows are taken by a hash of their id).
LABELLED_ROWS = 20_000

#: Byte classes counted in each text; a byte belongs to the first that holds it, else to "other".
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "blank": b" \t\r", "line": b"\n", "stop": b".!?", "comma": b",;:",
    "quote": b"'\"`", "bracket": b"()[]{}<>", "bar": b"|/\\", "dash": b"-_", "money": b"$#%&*@^~+=", "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
    "high": bytes(range(128, 256)),
}
_CLASS = np.zeros(256, np.int64) + len(CLASSES)
for _k, _members in reversed(list(enumerate(CLASSES.values()))):
    _CLASS[list(_members)] = _k
FEATURES = (
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in CLASSES), "word_length", "longest_word", "distinct_words", "repeated_pairs",
    "repeated_runs", "repeated_lines", "words_per_line", "words_per_stop", "one_byte_words", "upper_words", "stop_after_word", "mark_after_word",
)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text. Shares of nothing are 0, so an empty text has zeros."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    of = np.repeat(np.arange(rows), size)
    counts = np.bincount(of * (len(CLASSES) + 1) + _CLASS[data], minlength=rows * (len(CLASSES) + 1)).reshape(rows, -1)
    found = text.words(data, offsets)
    n = np.bincount(found.row, minlength=rows)
    length = found.end - found.start
    share = lambda part, whole: part / np.maximum(whole, 1)
    count = lambda keep: np.bincount(found.row[keep], minlength=rows)

    def repeated(k: int) -> np.ndarray:
        bag = text.shingles(found, rows, k)
        total = np.bincount(bag.row, bag.count, rows)
        return 1 - share(np.bincount(bag.row, minlength=rows), total) * (total > 0) - (total == 0)

    longest = np.zeros(rows)
    np.maximum.at(longest, found.row, length)
    lines = _lines(data, offsets, of)
    n_lines = np.bincount(lines.row, minlength=rows)
    same = np.bincount(lines.row, lines.count, rows)
    after = np.append(data, np.uint8(0))[found.end] if len(found.end) else np.zeros(0, np.uint8)
    initial = data[found.start] if len(found.start) else np.zeros(0, np.uint8)
    last = data[found.end - 1] if len(found.end) else np.zeros(0, np.uint8)
    caps = (initial >= 65) & (initial <= 90) & (last >= 65) & (last <= 90) & (length > 1)
    kinds = dict(zip(CLASSES, counts.T, strict=False))
    table = [
        np.log1p(size), np.log1p(n), np.log1p(same), *(share(kinds[c], size) for c in CLASSES),
        share(np.bincount(found.row, length, rows), n), np.log1p(longest), share(np.bincount(text.shingles(found, rows, 1).row, minlength=rows), n), repeated(2),
        repeated(5), 1 - share(n_lines, same) * (same > 0) - (same == 0), share(n, same), share(n, kinds["stop"]), share(count(length == 1), n), share(count(caps), n),
        share(count((after == 46) | (after == 33) | (after == 63)), n), share(count(_CLASS[after] == list(CLASSES).index("money")), n),
    ]
    return np.stack(table, 1).astype(np.float32)


def _lines(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> text.Shingles:
    """Distinct lines that are not empty, with counts."""
    inside = data != 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1 if len(data) else start
    whole = text.Words(text.span_hash(data, start, end), of[start] if len(start) else start, start, end)
    return text.shingles(whole, len(offsets) - 1, 1)


class Trees(NamedTuple):
    """Boosted trees as arrays: node k of tree t has a feature, a limit (to the left if at most), and its left child; the right one follows. Leaves lead to themselves."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all rows and trees a level at a time."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        while True:
            left = self.left[trees, node]
            to = np.where(left == node, node, left + (x[rows, self.feature[trees, node]] > self.limit[trees, node]))
            if (to == node).all():
                break
            node = to
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the log loss; splits are sought among the bins' edges by sums of gradients.

    With rows of one label only, or none, every score is the smoothed share of label 1.
    """
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(np.unique(y)) < 2:
        one = np.zeros((1, 1), np.int64)
        return Trees(one, one.astype(np.float32), one, one.astype(float), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    width, cols = bins + 1, x.shape[1]
    flat = binned + np.arange(cols) * width
    raw, made = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        nodes = [[0, 0.0, 0, 0.0]]
        of = np.zeros(len(y), np.int64)
        level = [0]
        for at_depth in range(depth + 1):
            following = []
            for node in level:
                own = np.flatnonzero(of == node)
                total_g, total_h = g[own].sum(), h[own].sum()
                nodes[node] = [0, 0.0, node, -rate * total_g / (total_h + ridge)]
                if at_depth == depth:
                    continue
                sums = [np.bincount(flat[own].ravel(), np.repeat(v[own], cols), cols * width).reshape(cols, width).cumsum(1)[:, :-1] for v in (g, h)]
                gain = sums[0] ** 2 / (sums[1] + ridge) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + ridge) - total_g**2 / (total_h + ridge)
                gain[(sums[1] < least) | (total_h - sums[1] < least)] = 0
                for c, e in enumerate(edges):
                    gain[c, len(e) :] = 0
                c, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[c, b] <= 1e-6:
                    continue
                left = len(nodes)
                nodes += [[0, 0.0, left, 0.0], [0, 0.0, left + 1, 0.0]]
                nodes[node] = [c, edges[c][b], left, 0.0]
                of[own] = left + (binned[own, c] > b)
                following += [left, left + 1]
            level = following
        raw += np.array([n[3] for n in nodes])[of]
        made.append(nodes)
    size = max(map(len, made))
    packed = np.array([n + [[0, 0.0, k, 0.0] for k in range(len(n), size)] for n in made])
    return Trees(packed[..., 0].astype(np.int64), packed[..., 1].astype(np.float32), packed[..., 2].astype(np.int64), packed[..., 3], start)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, whose labels are never learned."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _batch_features(column: pa.Array, block: int) -> np.ndarray:
    data, offsets = text.text_bytes(column)
    parts = [features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in text.blocks(offsets, block)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def _measure(block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _batch_features(batch.column(0), block)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def _score(model, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _batch_features(batch.column(0), block)
        score = np.concatenate([np.zeros(0), *(model.value.score(x[k : k + 4096]) for k in range(0, len(x), 4096))])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "_score"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED_ROWS, block: int = 1 << 19) -> Trees:
    """Fits on some ``rows`` labelled documents that are not held out, taken by a hash of their id.

    Null ids and labels are passed over; an id with several labels or texts counts with each.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").where(~held_out(F.col("_id")))
    share = min(1.0, rows / max(1, own.count()))
    sample = own.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text"))
    # The sample has about ``rows`` short rows whatever the number of labels.
    chosen = texts.join(F.broadcast(sample), texts["_doc"] == sample["_id"]).select("_text", "_label")
    got = chosen.mapInArrow(partial(_measure, block), "label int, x binary").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["label"]))  # the same trees whatever the order of rows
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], float))


def score_documents(docs: DataFrame, model: Trees, block: int = 1 << 19) -> DataFrame:
    """doc_id and score of every row. Only the text is looked at; a null one is empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(partial(_score, sent, block), "doc_id long, _score double").withColumnRenamed("_score", "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from ``threshold`` on). A null id is not held out."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, block: int = 1 << 19) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    ddl = f"_row {rows.schema['_row'].dataType.simpleString()}, _score double"
    scored = rows.mapInArrow(partial(_score, sent, block), ddl)
    return scored.where(F.col("_score") >= threshold).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
