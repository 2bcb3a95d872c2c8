"""Paged open-data tables: text columns, ``:id`` and ``:updated_at``."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import dedup_keep_last
from ..operators.tables import append_aligned
from ..session import materialise
from . import store
from .tables import exists

ID = ":id"
UPDATED = ":updated_at"


CSV = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": True}


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV pages with every column as text; missing columns are null.

    Quotes are doubled inside quoted values and names, which may hold line breaks. All pages below
    a folder are read, compressed ones too, in one scan for each distinct header, by name.
    """
    return read_pages(spark, [path])


def page_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file and header of every page below the paths: the text of its first record, with its line breaks.

    One scan of lines, of which each file keeps its first. Only files whose
    lines so far leave a quote open are looked at again, four times as far. Empty pages have no row.
    """
    def lines(files: list[str]) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", True).text(files)
        # Lines of a file's first split are numbered one after the other.
        numbered = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
        return numbered.where("at = 0")

    def quotes(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("file").agg(F.min_by("value", "n").alias("header")).withColumn("open", quotes(F.col("header")) % 2 == 1)

    def first_of(rows: DataFrame, count: int) -> DataFrame:
        """The lines up to the one that closes the quote, if it is among so many."""
        start = rows.groupBy("file").agg(F.min("n").alias("from"))
        near = rows.join(start, "file").where(F.col("n") < F.col("from") + count)
        kept = near.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("l"))
        upto = F.transform("l", lambda _, i: F.array_join(F.slice("l", F.lit(1), i + 1), "\n"))
        closed = F.get(F.filter(upto, lambda h: quotes(h) % 2 == 0), F.lit(0))
        return kept.select("file", F.coalesce(closed, F.array_join("l", "\n")).alias("header"), (closed.isNull() & (F.size("l") == count)).alias("open"))

    got = materialise(first(lines(paths)), "headers")
    done, count = got.where(~F.col("open")), 4
    while files := [unquote(r["file"]) for r in got.where("open").select("file").collect()]:
        got = materialise(first_of(lines(files), count), "headers")
        done, count = done.unionByName(got.where(~F.col("open"))), 4 * count
    return done.select("file", "header")


def read_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pages whose columns may differ; missing columns are null."""
    groups = page_headers(spark, paths).where("header != ''").groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    # Names of files, as any scan lists them.
    scans = [spark.read.options(**CSV).csv([unquote(f) for f in r["files"]]) for r in groups.orderBy("header").collect()]
    return reduce(append_aligned, scans or [spark.read.options(**CSV, recursiveFileLookup=True).csv(paths)])


def latest_records(df: DataFrame) -> DataFrame:
    """One row per id: the one updated last."""
    return dedup_keep_last(df, [ID], [UPDATED])


def next_part(spark: SparkSession, root: str) -> int:
    """Number that follows the last stored part or commit; 0 when there is none.
    Parts are folders and commits are ledger entries: only their names are read."""
    if not exists(spark, root):
        return 0
    if exists(spark, f"{root}/ledger"):
        names, start, end = _names(spark, f"{root}/ledger"), "", ".json"
    else:
        names, start, end = _names(spark, root), "part=", ""
    found = [n.removeprefix(start).removesuffix(end) for n in names if n.startswith(start) and n.endswith(end)]
    return max((int(n) + 1 for n in found if n.isdigit()), default=0)


def _names(spark: SparkSession, folder: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def append_parts(df: DataFrame, root: str) -> int:
    """Stores rows as the next numbered part and returns its number."""
    part = next_part(df.sparkSession, root)
    df.withColumn("part", F.lit(part)).write.mode("append").partitionBy("part").parquet(root)
    return part


#: Partitions of a store by a hash of the id; an increment rewrites those that its ids fall into.
ID_BUCKETS = 64


def load_increment(new: DataFrame, root: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """Merges only rows newer than what is stored, one row per id; returns the current table.

    How far the stored rows go is known from the ledger of :mod:`.store`; the
    stored rows themselves are read only in the buckets that get new ones. A
    store keeps the number of buckets it began with.
    """
    spark = new.sparkSession
    mark = store.last_entry(spark, root)["mark"]
    fresh = new if mark is None else new.where(F.col(f"`{UPDATED}`") > F.lit(mark))
    store.commit(fresh, root, [ID], [UPDATED], F.pmod(F.xxhash64(ID), F.lit(buckets)), mark=UPDATED)
    return store.read_store(spark, root)
