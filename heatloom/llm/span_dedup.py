"""Removes sentences of repeated spans: runs of several consecutive sentences that an earlier text also has."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm import text

# A passage of 51 words may lose 10 at each end; what is left holds a run: one has 3 * 10 words at most.
RUN, LEAST_WORDS, MOST_WORDS = 3, 16, 10
SPANS = "id long, key long, span long"


def sentence_starts(data: np.ndarray, found: text.Words, most_words: int) -> np.ndarray:
    """Numbers of the words that begin a sentence.

    A sentence ends at a line break, or at ``.``, ``!`` or ``?`` before a blank;
    a longer one is cut after every ``most_words`` words.
    """
    n = len(found.hash)
    if not n:
        return np.zeros(0, np.int64)
    blank = np.append(data[1:] <= 32, True)
    ends = np.cumsum((data == 10) | (((data == 46) | (data == 33) | (data == 63)) & blank))
    new = np.ones(n, bool)
    new[1:] = (found.row[1:] != found.row[:-1]) | (ends[found.start[1:]] > ends[found.end[:-1] - 1])
    number = np.arange(n)
    return np.flatnonzero((number - np.maximum.accumulate(np.where(new, number, 0))) % most_words == 0)


def piece_starts(data: np.ndarray, found: text.Words, most_words: int) -> np.ndarray:
    """Numbers of the words that begin a sentence or a piece of a long one.

    Of every ``most_words`` consecutive words within a sentence of more, the one
    of the least hash (the last of equals) begins a piece. So no piece is longer,
    and equal words get equal cuts wherever the sentences around them begin.
    """
    n = len(found.hash)
    starts = sentence_starts(data, found, max(n, 1))
    if n < most_words:
        return starts
    size = np.diff(np.append(starts, n))
    sentence = np.repeat(np.arange(len(starts)), size)
    window = np.arange(n - most_words + 1)
    window = window[(sentence[window] == sentence[window + most_words - 1]) & (size[sentence[window]] > most_words)]
    least = window.copy()
    for k in range(1, most_words):
        least = np.where(found.hash[window + k] <= found.hash[least], window + k, least)
    return np.union1d(starts, least)


def _runs(found: text.Words, starts: np.ndarray, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences and hash of the words of runs within one row.

    Runs are the shortest with ``run`` sentences and ``least_words`` words that
    begin with, or end with, each sentence. So every sentence of a passage that
    is long enough for one run lies in some run that is inside the passage.
    """
    n = len(starts)
    edges, row, number = np.append(starts, len(found.hash)), found.row[starts], np.arange(n)
    end = np.maximum(number + run, np.searchsorted(edges, edges[:n] + least_words, "left"))
    begin = np.minimum(number + 1 - run, np.searchsorted(edges, edges[1:] - least_words, "right") - 1)
    on, back = np.flatnonzero(end <= n), np.flatnonzero(begin >= 0)
    on, back = on[row[end[on] - 1] == row[on]], back[row[begin[back]] == row[back]]
    both = np.unique(np.append(on << 32 | end[on], begin[back] << 32 | back + 1))
    at, stop = both >> 32, both & 0xFFFFFFFF
    return at, stop - at, text.range_mix(found.hash, edges[at], edges[stop])


def _repeats(row: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Whether the same row has the same span before."""
    order = np.lexsort((np.arange(len(span)), span, row))
    again = np.zeros(len(span), bool)
    again[order[1:]] = (span[order[1:]] == span[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return again


def _spans(run: int, least_words: int, most_words: int, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct span of each row."""
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(1))
        for lo, hi in text.blocks(offsets, block):
            part = data[offsets[lo] : offsets[hi]]
            found = text.words(part, offsets[lo : hi + 1] - offsets[lo])
            starts = piece_starts(part, found, most_words)
            at, _, span = _runs(found, starts, run, least_words)
            row = found.row[starts[at]]
            new = ~_repeats(row, span)
            which = pa.array(lo + row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(2).take(which), pa.array(span[new].view(np.int64))], ["id", "key", "span"])


def _cut(run: int, least_words: int, most_words: int, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, spans that an earlier text has, ...): the rows with the sentences of those and of their own repeats cut out."""
    for batch in batches:
        data, offsets = text.text_bytes(batch.column(0))
        marks = batch.column(1)
        kept, sentences, removed = [], [], []
        for lo, hi in text.blocks(offsets, block):
            base, at = offsets[lo], offsets[lo : hi + 1] - offsets[lo]
            part = data[base : offsets[hi]]
            found = text.words(part, at)
            starts = piece_starts(part, found, most_words)
            row = found.row[starts]
            count = np.bincount(row, minlength=hi - lo)
            first = np.cumsum(count) - count
            begin = found.start[starts]
            place, size, span = _runs(found, starts, run, least_words)
            gone = _repeats(row[place], span)
            own_runs = np.searchsorted(row[place], np.arange(hi - lo + 1))
            for k in range(hi - lo):
                if mark := marks[lo + k].as_py():
                    of_row = slice(own_runs[k], own_runs[k + 1])
                    gone[of_row] |= np.isin(span[of_row].view(np.int64), np.array(mark))
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, place[gone], 1)
            np.add.at(change, place[gone] + size[gone], -1)
            covered = np.cumsum(change)[:-1] > 0
            lost = np.bincount(row, covered, hi - lo).astype(np.int64)
            for k in range(hi - lo):
                own = bytes(part[at[k] : at[k + 1]])
                if lost[k]:
                    # A sentence reaches to the next one; what precedes the first stays.
                    mine = slice(first[k], first[k] + count[k])
                    edges = np.append(begin[mine] - at[k], len(own))
                    own = own[: edges[0]] + b"".join(own[edges[s] : edges[s + 1]] for s in np.flatnonzero(~covered[mine]))
                kept.append(own)
            sentences += count.tolist()
            removed += lost.tolist()
        texts = pc.if_else(batch.column(0).is_valid(), pa.array(kept, pa.binary()).cast(pa.string()), pa.scalar(None, pa.string()))
        others = {n: batch.column(n) for n in batch.schema.names[2:]}
        yield pa.RecordBatch.from_pydict(
            {"text": texts, "n_sentences": pa.array(sentences, pa.int64()), "n_removed": pa.array(removed, pa.int64()), **others}
        )


def text_key(c: Column) -> Column:
    return F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))


def repeated_spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, block: int = 1 << 19) -> DataFrame:
    """id, key and all spans that an earlier document has.

    The first is the one with the smallest doc_id (null before all), then text
    key. A document holds each span once on the way to the join, so a much
    repeated line does not pile up; a span's owner is found by partial
    aggregation, and the join back may be split where one span is very frequent.
    Spans are hashed twice rather than written.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))
    spans = rows.mapInArrow(partial(_spans, run, least_words, most_words, block), SPANS)
    number = F.coalesce("id", F.lit(-(1 << 63)))
    owner = spans.groupBy(F.col("span").alias("owned")).agg(F.min(number).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("owned", "low")
    shared = spans.join(owner, F.col("span") == F.col("owned"))
    # Rows with the owner's id but other texts are told apart by their key.
    # Not by "=", which would become a join key and deal all spans out once more.
    mine = number <= F.col("low")
    rivals = shared.where(mine).groupBy(F.col("span").alias("owned")).agg(F.min("key").alias("owner_key"), F.max("key").alias("last_key")).where("owner_key != last_key").select("owned", "owner_key")
    later = shared.where(~mine).select("id", "key", "span").unionByName(
        shared.where(mine).drop("owned").join(rivals, F.col("span") == F.col("owned")).where("key != owner_key").select("id", "key", "span")
    )
    return later.groupBy("id", "key").agg(F.collect_set("span").alias("marks"))


def drop_repeated_sentences(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, block: int = 1 << 19) -> DataFrame:
    """The documents with every sentence cut out that a non-first repeated span covers.

    A sentence of more than ``most_words`` words counts as several, cut at
    places that its words decide.
    Returns text, n_sentences and n_removed, and the other columns of ``docs``
    in front under their names. Rows equal in doc_id and text are one document
    here and come back alike. A null text stays null and an empty one empty;
    neither has sentences. Spans are the shortest runs of at least ``run``
    sentences and ``least_words`` words, compared word by word, lower-cased.
    """
    marks = repeated_spans(docs, run, least_words, most_words, block)
    marks = marks.select(F.col("id").alias("_span_id"), F.col("key").alias("_span_key"), F.col("marks").alias("_span_marks"))
    joined = docs.join(marks, docs["doc_id"].cast("long").eqNullSafe(marks["_span_id"]) & (text_key(docs["text"]) == marks["_span_key"]), "left")
    others = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    ddl = "text string, n_sentences long, n_removed long" + (", " + fields if others else "")
    cut = joined.select(docs["text"].cast("string").alias("text"), F.col("_span_marks").alias("_marks"), *(docs[c] for c in others))
    out = cut.mapInArrow(partial(_cut, run, least_words, most_words, block), ddl)
    return out.select(*others, "text", "n_sentences", "n_removed")


def dedupe_spans(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, without repeated sentences; those that lose all of them go."""
    out = drop_repeated_sentences(docs).where("n_removed = 0 or n_removed < n_sentences")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(c) for c in docs.columns))
