"""A stored table that new rows are merged into by rewriting only the partitions they touch.

``rows/store_part=<p>/store_commit=<version>`` holds the files, ``ledger/<n>.json`` one entry for each commit: the partitions
it rewrote, the version it gave them, the batch it took in, the highest mark of its rows and the columns so far. A partition's
current version is that of the last entry that names it, so reading merges nothing and files that no entry names
(of a run that failed, or replaced ones) are not seen. An entry appears at once, by a rename, after its
files: a commit happens whole or not at all. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import dedup_keep_last, upsert_keep_last
from ..session import materialise
from .tables import exists

PART, COMMIT = "store_part", "store_commit"
ENTRY = "number long, version string, batch string, mark string, parts array<string>, columns string"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row for each commit."""
    path = f"{root}/ledger"
    if not exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(path)


def current_parts(spark: SparkSession, root: str) -> DataFrame:
    """store_part and version of every partition: a row for each, whatever the number of commits."""
    named = ledger(spark, root).select("number", "version", F.explode("parts").alias(PART))
    return named.groupBy(PART).agg(F.max_by("version", "number").alias("version"))


def last_entry(spark: SparkSession, root: str):
    """number, mark (the highest of all commits) and columns of the last commit; all null without any."""
    return ledger(spark, root).agg(
        F.max("number").alias("number"), F.max("mark").alias("mark"), F.max_by("columns", "number").alias("columns")
    ).first()


def _read(spark: SparkSession, root: str, parts: list, columns: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(columns))
    paths = [f"{root}/rows/{PART}={p[PART]}/{COMMIT}={p['version']}" for p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, root: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The current rows, or those of some partitions. Columns that older files lack are null."""
    last = last_entry(spark, root)
    if last["columns"] is None:
        raise FileNotFoundError(f"nothing was committed to {root}")
    chosen = current_parts(spark, root)
    if parts is not None:
        chosen = chosen.where(F.col(PART).isin(list(parts)))
    return _read(spark, root, chosen.collect(), last["columns"])  # names of partitions, not rows


def commit(
    new: DataFrame, root: str, keys: Sequence[str], seq: Sequence[str], by: Column, batch: str | None = None, mark: str | None = None,
) -> int | None:
    """Merges rows by ``keys``: new rows win over stored ones, the greater ``seq`` wins among the new. Returns the commit's number.

    ``by`` is the partition of a row and must follow from its keys (a date, a hash of them). Stored partitions
    without new rows are neither read nor written. A ``batch`` that was committed before changes nothing (None), so a replay is
    harmless. ``mark`` names a text column whose highest value is kept in the ledger.
    """
    spark = new.sparkSession
    done = ledger(spark, root)
    if batch is not None and not done.where(F.col("batch") == batch).isEmpty():
        return None
    part = F.coalesce(by.cast("string"), F.lit("none"))
    # Used for the list of partitions, the mark and the merge.
    fresh = materialise(dedup_keep_last(new, keys, seq).withColumn(PART, part), "fresh")
    touched = [r[PART] for r in fresh.select(PART).distinct().collect()]
    highest = fresh.agg(F.max(F.col(f"`{mark}`").cast("string")).alias("m")).first()["m"] if mark else None
    last = last_entry(spark, root)
    number = 0 if last["number"] is None else last["number"] + 1
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    merged, columns = fresh, None
    if last["columns"] is not None:
        stored = current_parts(spark, root).where(F.col(PART).isin(touched)).collect()
        old = _read(spark, root, stored, last["columns"])
        merged = upsert_keep_last(old, fresh.drop(PART), keys, seq).withColumn(PART, part)
    columns = merged.drop(PART).schema.json()
    if touched:
        out = merged.withColumn(COMMIT, F.lit(version)).hint("rebalance", F.col(PART))
        out.write.mode("append").partitionBy(PART, COMMIT).parquet(f"{root}/rows")
    entry = {"number": number, "version": version, "batch": batch, "mark": highest, "parts": touched, "columns": columns}
    _put(spark, f"{root}/ledger", f"{number:08d}.json", json.dumps(entry))
    return number


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file that appears complete, and only if none of its name is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = path(folder, name), path(folder, f"_{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"another writer has committed {name} in {folder}")


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes versions that are not current, which only readers that began before may still use; returns how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    rows = path(f"{root}/rows")
    files = rows.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {(r[PART], r["version"]) for r in current_parts(spark, root).collect()}
    gone = 0
    for part in files.listStatus(rows):
        if not part.isDirectory():
            continue
        for version in files.listStatus(part.getPath()):
            names = (part.getPath().getName().removeprefix(f"{PART}="), version.getPath().getName().removeprefix(f"{COMMIT}="))
            if version.isDirectory() and names not in kept:
                gone += files.delete(version.getPath(), True)
    return gone
