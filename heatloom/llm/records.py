"""Token records in length-delimited binary files with an offset index.

A record is framed as: payload length (8 bytes), masked checksum of those 8
bytes (4), payload, masked checksum of the payload (4); all little-endian. The
payload holds a flag for a null id (1), the id (8), the width of a token id (1)
and the ids. Each file ``part-N.rec`` has an index ``part-N.idx`` of one
(offset, length) pair of 8-byte integers for each record, so any record can be
read by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatloom.llm.tokens import END_ID, WIDTH, default_tokenizer, encoder
from heatloom.session import materialise, scratch_path

_HEAD, _CHECK, _ID, _PAIR = "<Q", "<I", "<?qB", "<QQ"
_BUFFER = 1 << 20
MANIFEST = "part int, path string, n_records long, n_tokens long"
RECORDS = "doc_id long, part int, first long, ids binary"
RECORDS_KINDS = {"doc_id": pa.int64(), "part": pa.int32(), "first": pa.int64(), "ids": pa.binary()}
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
DIGEST_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that a checksum of checksums stays sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack(_HEAD, len(payload))
    return b"".join((head, struct.pack(_CHECK, masked(head)), payload, struct.pack(_CHECK, masked(payload))))


def unframe(stream, length: int | None = None) -> bytes | None:
    """The next payload, or None at the end. A damaged record raises ValueError."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack(_CHECK, head[8:])[0] != masked(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack(_HEAD, head[:8])[0]
    if length is not None and size + 16 != length:
        raise ValueError("the index does not fit the record")
    body = stream.read(size + 4)
    if len(body) < size + 4 or struct.unpack(_CHECK, body[size:])[0] != masked(body[:size]):
        raise ValueError("damaged record")
    return body[:size]


def pack_ids(doc_id: int | None, ids: bytes) -> bytes:
    """Two bytes for each id where all of them fit, else four."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    return struct.pack(_ID, doc_id is None, doc_id or 0, width) + (wide.astype("<u2").tobytes() if width == 2 else ids)


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    null, doc_id, width = struct.unpack_from(_ID, payload)
    ids = payload[struct.calcsize(_ID) :]
    return None if null else doc_id, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int):
    end = struct.pack(_CHECK, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        encode, task = encoder(tokenizer), TaskContext.get()
        part, name = task.partitionId(), f"{root}/part-{task.partitionId():06d}"
        trial = f"{name}.{task.taskAttemptId()}"
        records = tokens = at = 0
        with store.open_output_stream(f"{trial}.rec.tmp", buffer_size=_BUFFER) as data, store.open_output_stream(f"{trial}.idx.tmp", buffer_size=_BUFFER) as index:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    record = frame(pack_ids(doc_id, ids))
                    data.write(record)
                    index.write(struct.pack(_PAIR, at, len(record)))
                    at, records, tokens = at + len(record), records + 1, tokens + len(ids) // WIDTH
        # A repeated task replaces the files of the lost one by equal ones.
        for kind in ("rec", "idx"):
            store.move(f"{trial}.{kind}.tmp", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}"], "n_records": [records], "n_tokens": [tokens]}
        )

    return write



def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every text and writes the ids in ascending order of doc_id; returns one row per file.

    Rows are dealt out by ranges of doc_id, so the files follow each other, and
    equal ids by their text, so one id on many rows is not one task. Null ids
    come first, null texts are empty, repeated rows are all written. An empty
    table gives no records. Other columns are not read. Texts pass through a
    task one at a time; a record is held whole.
    """
    spark = docs.sparkSession
    store, root = _store(folder)
    store.create_dir(root)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return materialise(dealt.mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end_id), MANIFEST), "manifest")


def _spans(stream, span: list[int]) -> Iterator[tuple[int | None, bytes]]:
    """The record at an (offset, length), or else all records of a file."""
    if span:
        stream.seek(span[0])
        yield unpack_ids(unframe(stream, span[1]))
    else:
        while (payload := unframe(stream)) is not None:
            yield unpack_ids(payload)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (part, path, offset?, length?): the records with their ids."""
    for batch in batches:
        found, size = [], 0
        for part, path, *span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, name = _store(path)
            first = 0
            with store.open_input_file(f"{name}.rec") if span else store.open_input_stream(f"{name}.rec", buffer_size=_BUFFER) as stream:
                for doc_id, ids in _spans(stream, span):
                    found.append((doc_id, part, first, ids))
                    first, size = first + len(ids) // WIDTH, size + len(ids)
                    if size > 1 << 23:
                        yield _rows(found, RECORDS_KINDS)
                        found, size = [], 0
        yield _rows(found, RECORDS_KINDS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (path, ids before the file): what the records hold, without the ids."""
    for batch in batches:
        for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, name = _store(path)
            found = []
            with store.open_input_stream(f"{name}.rec", buffer_size=_BUFFER) as stream:
                for doc_id, ids in _spans(stream, []):
                    n = len(ids) // WIDTH
                    found.append((doc_id, start, n, zlib.crc32(ids)))
                    start += n
            yield _rows(found, DIGEST_KINDS)


def _rows(found: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def read_records(files: DataFrame) -> DataFrame:
    """All records of the files of a manifest, checked; ``first`` counts the file's ids before the record."""
    return files.select("part", "path").repartition(max(1, files.count()), "part").mapInArrow(_read, RECORDS)


def read_index(files: DataFrame) -> DataFrame:
    """part, path, offset and length of every record, from the index files only."""

    def read(batches):
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_stream(f"{name}.idx") as index:
                    pairs = np.frombuffer(index.read(), "<u8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(pairs), part, np.int32)), "path": pa.array([path] * len(pairs), pa.string()),
                    "offset": pairs[:, 0], "length": pairs[:, 1],
                })

    return files.select("part", "path").mapInArrow(read, "part int, path string, offset long, length long")


def read_shuffled(files: DataFrame, seed: int) -> DataFrame:
    """All records in an order fixed by the seed: the index is shuffled, then each record is read at its offset."""
    order = F.xxhash64(F.lit(seed), "part", "offset")
    spots = read_index(files).withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order", "part", "offset")
    return spots.select("part", "path", "offset", "length").mapInArrow(_read, RECORDS).drop("first")


def digest(files: DataFrame) -> DataFrame:
    """Per record, read back from the files: doc_id, start, n_tokens and ids_crc32 of its ids."""
    # One row per file; the running total is the only step without a key.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("path", before.cast("long").alias("start")).repartition(max(1, files.count()), "path")
    return starts.mapInArrow(_digest, DIGEST)


def token_records(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the records to the shared scratch folder and digests what the files hold."""
    return digest(write_records(docs, scratch_path(spark, "records"), tokenizer))
