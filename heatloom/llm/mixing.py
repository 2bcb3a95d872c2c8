"""Mixes sources to target weights: certain whole copies, then Pareto order sampling for the rest.

A document's expected number of copies is its source's level times its preference, at most ``cap``.
Its whole part is certain. The fraction is the document's inclusion probability p in a sample of
fixed size, counted in words: documents are ranked by the odds of a random number divided by the odds
of p, and taken in that order until the words that the whole copies leave open are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.session import materialise

CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 20
#: Ranks are cut by two histograms of this many bits each before single documents are sorted.
BITS = 12


def words(text: Column) -> Column:
    """Runs of characters other than blanks and the controls from tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shorter_first(size: Column) -> Column:
    """The default preference: 32 less the binary digits of the size, so long documents are repeated a little less. At most 32 classes."""
    return F.greatest(F.lit(1), F.lit(32) - F.length(F.bin(size))).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1 fixed by seed, id and text, with 53 binary digits."""
    known = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(" ")), F.lit("|"), F.coalesce(F.md5(text), F.lit(" "))))
    return (F.conv(F.substring(known, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target from (source, source_size), one row each.

    Sources by code point, null last, weigh ``weights`` over and over; targets share all words by weight,
    stop at ``cap`` times the source's size, and the excess is shared again until none is above.
    Ranks are counted per sorted partition, and each round is one aggregate.
    """
    order = F.col("source").asc_nulls_last()
    placed = sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}), "sources")
    # One row for each partition, not for each source.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_row") + F.col("_start"), F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(placed.join(starts, F.col("_part") == F.col("_p")).select("source", "source_size", turn.cast("long").alias("weight")), "weights")
    limit, left, weight, stopped = F.col("source_size") * cap, None, None, F.lit(False)
    while True:
        now = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(stopped, limit)), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)).alias("weight")
        ).first()
        if (now["all"] - now["given"], now["weight"]) == (left, weight):
            break
        left, weight = now["all"] - now["given"], now["weight"]
        if not weight:
            break
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(weight))
        stopped = share > limit
    target = limit.cast("double") if not weight else F.when(stopped, limit.cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def copies(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """From (source, target, source_size, preference, class_size): whole copies, the fraction p, and the words that a source's whole copies leave open.

    The level solves: the sum of min(cap, level * preference) * size is the target.
    """
    group = Window.partitionBy("source")
    down = group.orderBy(F.col("preference").desc())
    higher = F.coalesce(F.sum("class_size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("preference") * F.col("class_size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.withColumn("_level", (F.col("target") - F.lit(float(cap)) * higher) / rest.cast("double"))
    level = F.max(F.when(F.col("_level") * F.col("preference") <= cap, F.struct("preference", "_level"))).over(group)
    exact = F.when((F.col("target") >= F.lit(cap) * F.col("source_size")) | level.isNull() | (F.col("preference") > level["preference"]), F.lit(float(cap)))
    expected = tried.withColumn("_copies", exact.otherwise(F.least(F.lit(float(cap)), level["_level"] * F.col("preference"))))
    whole = expected.withColumn("whole", F.floor("_copies")).withColumn("p", F.col("_copies") - F.col("whole"))
    return whole.withColumn("open", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(group)).drop("_level", "_copies")


def _limits(rows: DataFrame, name: str) -> DataFrame:
    """_s (each source of ``rows``), limit and gap: draws below the limit (all, if null) are taken in order and leave the gap of the words ``open``.

    A histogram of the draws tells in which bucket the words pass those open, one of that bucket in which part of
    it, and only the draws of that part are sorted.
    """
    here = rows.withColumn("before", F.lit(0).cast("long"))
    totals = None
    for bits in (BITS, 2 * BITS):
        digit = F.floor(F.col("v") * F.lit(float(1 << bits)))
        counted = here.groupBy("source", digit.alias("_digit")).agg(F.sum("size").alias("_n"), F.first("open").alias("open"), F.first("before").alias("before"))
        upto = Window.partitionBy("source").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        running = materialise(counted.withColumn("_c", F.col("before") + F.sum("_n").over(upto)), f"{name}-{bits}")
        if totals is None:
            totals = running.groupBy(F.col("source").alias("_s")).agg(F.max("_c").alias("_all"), F.first("open").alias("_open"))
        cut = running.where((F.col("_c") > F.col("open")) & (F.col("_c") - F.col("_n") <= F.col("open")))
        cut = materialise(cut.select(F.col("source").alias("_source"), F.col("_digit").alias("_cut"), (F.col("_c") - F.col("_n")).alias("_before")), f"{name}-cut")
        here = here.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (digit == F.col("_cut"))).select("source", "size", "v", "open", F.col("_before").alias("before"))
    upto = Window.partitionBy("source").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    last = here.withColumn("_c", F.col("before") + F.sum("size").over(upto)).groupBy(F.col("source").alias("_l")).agg(
        F.min(F.when(F.col("_c") > F.col("open"), F.col("v"))).alias("limit"), F.max(F.greatest(F.col("before"), F.when(F.col("_c") <= F.col("open"), F.col("_c")))).alias("_words")
    )
    joined = totals.join(last, F.col("_s").eqNullSafe(F.col("_l")), "left")
    return materialise(joined.select("_s", "limit", (F.col("_open") - F.coalesce("_words", "_all")).alias("gap")), f"{name}-limits")


def _fill(beyond: DataFrame) -> DataFrame:
    """_f (a source) and picks: the draws, of those not taken, that bring it nearer to its target. ``beyond`` has source, size, v and gap.

    The largest of each binary length that fit the gap are taken as long as they fit, from the largest on; or the
    smallest that is too large, if it comes nearer. That is at most one candidate for each binary digit of a size.
    """
    size, draw_ = F.col("size"), F.col("v")
    fits = beyond.where("size <= gap").groupBy(F.col("source").alias("_f"), F.length(F.bin(size))).agg(F.min(F.struct((-size).alias("n"), "v")).alias("m"))
    over = beyond.where("size > gap").groupBy(F.col("source").alias("_f")).agg(F.min(F.struct(size.alias("n"), "v")).alias("m"))
    tried = fits.select("_f", F.col("m.v").alias("_v"), F.lit(False).alias("over")).unionByName(over.select("_f", F.col("m.v").alias("_v"), F.lit(True).alias("over")))
    # Rows of one draw go together.
    same = F.col("source").eqNullSafe(F.col("_f")) & (draw_ == F.col("_v"))
    whole = beyond.join(materialise(tried, "tried"), same).groupBy("_f", "_v", "over").agg(F.sum("size").cast("double").alias("n"), F.first("gap").alias("gap"))
    ordered = whole.groupBy("_f").agg(
        F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.when(~F.col("over"), F.struct((-F.col("n")).alias("n"), "_v")))).alias("list"), F.max(F.when(F.col("over"), F.struct("n", "_v"))).alias("over")
    )
    none = F.array().cast("array<double>")
    taken = F.aggregate("list", F.struct(F.col("gap").alias("left"), none.alias("picks")), lambda a, c: F.when(-c["n"] <= a["left"], F.struct((a["left"] + c["n"]).alias("left"), F.array_append(a["picks"], c["_v"]).alias("picks"))).otherwise(a))
    chosen = ordered.withColumn("_t", taken)
    return chosen.select("_f", F.when(F.col("over.n") - F.col("gap") < F.col("_t.left"), F.array("over._v")).otherwise(F.col("_t.picks")).alias("picks"))


def _taken() -> Column:
    """Whether a draw is taken in order (columns of ``ends``)."""
    later = (F.col("size") <= F.col("gap1")) & (F.col("limit2").isNull() | (F.col("v") < F.col("limit2")))
    return F.coalesce(F.col("limit1").isNull() | (F.col("v") < F.col("limit1")) | later, F.lit(False))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, preference: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words) and copies.

    ``preference`` is a whole-number column over ``size`` and the columns of ``docs``, at least 1, with few
    distinct values (a quality grade, say): expected copies grow with it. After the sample, a few documents
    are added that fill the gap to the target best (see ``_fill``). No document is taken more than ``cap`` times.

    The draw depends on seed, id and text only, so reruns and other partitions agree. Rows equal in id and
    text share it and are taken alike. Null and blank texts have size 0 and take nothing; null ids are
    ids of their own kind, the null source is the last; an empty table gives no rows; other columns are not
    read but for ``preference``. A source with a third of all rows is cut by histograms of its ranks
    (4,096 buckets, then 4,096 of the bucket that holds the cut), and only what shares 24 binary
    digits of rank with the cut is sorted.
    """
    size = words(F.col("text").cast("string"))
    sized = docs.withColumn("size", size).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size",
        F.when(F.col("size") > 0, (shorter_first(F.col("size")) if preference is None else preference).cast("long")).alias("preference"),
        draw(F.col("doc_id"), F.col("text").cast("string"), seed).alias("u"),
    )
    sized = materialise(sized, "sized")
    by_class = materialise(sized.groupBy("source", "preference").agg(F.sum("size").alias("class_size")), "classes")
    targets = materialise(source_targets(by_class.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, cap), "targets")
    goals = targets.select(F.col("source").alias("_s"), "source_size", "target")
    classes = by_class.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").where("class_size > 0")
    plan = materialise(copies(classes, cap).select(F.col("source").alias("_s"), F.col("preference").alias("_p"), "whole", "p", "open"), "plan")
    # Classes and sources are few beside the documents; Spark broadcasts them or splits a crowded source.
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("preference") == F.col("_p"))).drop("_s", "_p")
    odds = F.col("u") * (1 - F.col("p")) / ((1 - F.col("u")) * F.col("p"))
    ranked = planned.where("p > 0").withColumn("_odds", odds).select("source", "size", (F.col("_odds") / (1 + F.col("_odds"))).alias("v"), "open")
    ranked = materialise(ranked, "ranked")

    # In order until a document is too large, then in order those that still fit, then the best for the rest.
    first = _limits(ranked, "first").withColumnsRenamed({"limit": "limit1", "gap": "gap1"})
    known = ranked.join(first, F.col("source").eqNullSafe(F.col("_s")))
    second = _limits(known.where("v >= limit1 and size <= gap1").select("source", "size", "v", F.col("gap1").alias("open")), "second")
    second = second.select(F.col("_s").alias("_s2"), F.col("limit").alias("limit2"), F.col("gap").alias("gap2"))
    ends = materialise(first.join(second, F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2"), "both")
    beyond = ranked.join(ends, F.col("source").eqNullSafe(F.col("_s"))).where("limit1 is not null").where(~_taken())
    picks = materialise(_fill(beyond.select("source", "size", "v", F.coalesce("gap2", "gap1").alias("gap"))), "fills")
    ends = materialise(ends.join(picks, F.col("_s").eqNullSafe(F.col("_f")), "left").select("_s", "limit1", "gap1", "limit2", "picks"), "ends")

    rules = plan.drop("open").withColumnsRenamed({"_s": "_r"})
    own = sized.join(rules, F.col("source").eqNullSafe(F.col("_r")) & (F.col("preference") == F.col("_p")), "left")
    own = own.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").join(goals.withColumnRenamed("_s", "_g"), F.col("source").eqNullSafe(F.col("_g")))
    own = own.withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds)))
    drawn = F.when(F.col("v").isNotNull() & (_taken() | F.coalesce(F.array_contains("picks", F.col("v")), F.lit(False))), 1).otherwise(0)
    number = F.coalesce(F.col("whole") + drawn, F.lit(0)).cast("int")
    return own.select("doc_id", "size", "source_size", "target", (F.col("size") * number).cast("long").alias("taken"), number.alias("copies"))
