"""Mixing sources to target weights on a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear. Its integral is the source's share of all
words; its running integral is the source's cumulative demand. A source's documents stand in a fixed random order and
repeat as often as the target asks (at most `cap` times); a document at cumulative word c of its stream is read at the
time when the demand reaches c, which inverts a quadratic in each linear segment. The mix is range-sorted by that
position.

Prefix sums run in two levels: words per (source, leading hash digits) first, then inside such a bucket, so that a
source, or a doc_id, that holds most rows is spread over thousands of tasks; the hash is of doc_id and text, so only rows equal in both stay together. Nothing but one row per source is ever gathered.

Defined cases: null text has no words; a null source is a source of its own, last; documents without words get nothing
to give and no position; rows of equal doc_id and text stand beside each other in the order; a very long text is a document as
any, cut where its source's target is met; an empty table gives an
empty mix. Columns of the input that are called like those made here are replaced in the plan only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import null_last, split_words, stage, table

#: A schedule's shape: (time, height) knots from time 0 to 1. Only its form counts; weights set its integral.
Shape = Sequence[tuple[float, float]]
FLAT: Shape = ((0.0, 1.0), (1.0, 1.0))
RISING: Shape = ((0.0, 0.5), (1.0, 1.5))
FALLING: Shape = ((0.0, 1.5), (1.0, 0.5))
#: Rows that one bucket of the second level should hold at most, on average.
BUCKET_ROWS = 1 << 16


def segments(shape: Shape) -> Column:
    """The schedule's linear pieces: share of the integral before it, its start, length, and height at both ends."""
    if shape[0][0] != 0 or shape[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(shape, shape[1:])) or min(h for _, h in shape) < 0:
        raise ValueError("a schedule runs from time 0 to 1 with heights of 0 or more")
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(shape, shape[1:]))
    if whole <= 0:
        raise ValueError("a schedule needs some height")
    parts, done = [], 0.0
    for (t0, h0), (t1, h1) in zip(shape, shape[1:]):
        parts.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in (("u", done), ("t", t0), ("w", t1 - t0), ("a", h0 / whole), ("b", h1 / whole)))))
        done += (t1 - t0) * (h0 + h1) / 2 / whole
    return F.array(*parts)


def time_of(u: Column, parts: Column) -> Column:
    """The time at which the share u (0 to 1) of the schedule's integral is reached."""
    held = F.filter(parts, lambda p: p["u"] <= u)
    p = F.element_at(held, -1)
    rest, slope = u - p["u"], (p["b"] - p["a"]) / p["w"]
    # a*x + slope*x*x/2 = rest, in the form that is safe for a slope of 0
    root = F.sqrt(F.greatest(p["a"] * p["a"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), p["t"] + F.when(p["a"] + root == 0, 0.0).otherwise(2 * rest / (p["a"] + root)))


def targets(per_source: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """per_source(key, source_size) with its rank by key, weight and target.

    Targets share the words of all by weight; none exceeds cap times its source's words, what is over goes to the others
    by weight. With the sources sorted by cap * words / weight, the capped ones are a prefix, so two running sums settle it: the level after the
    first k are capped is right where the next one stays open, and lower for every larger k.
    """
    if cap < 1 or min(weights) <= 0:
        raise ValueError("weights are positive and cap is at least 1")
    by_key, all_rows = Window.orderBy("key"), Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn("rank", F.row_number().over(by_key) - 1).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    tight = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "key")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
    return ranked.withColumn("rate", F.max(F.when(F.col("open"), F.col("level"))).over(all_rows)).withColumn(
        "target", F.when(F.col("rate").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("rate") * F.col("weight"))))


def sized(docs: DataFrame) -> DataFrame:
    """docs with key (of the source), order (a fixed random order) and size (words)."""
    return docs.withColumns({
        "key": null_last(F.col("source")),
        "order": F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))),
        "size": F.size(split_words(F.coalesce("text", F.lit("")))).cast("long"),
    })


def placed(rows: DataFrame, counts: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, shapes: Sequence[Shape] = (FLAT,), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (of `sized`, any further columns) with source_size, target, taken, copies, starts and position.

    counts: the same rows' key, order and size, staged, for the passes that need no more. taken: words the mix reads of
    the document, repeats counted; the last round through a source is cut at the word where its target is met. copies: whole
    repeats, the cut one counting if half of it is read. position: the word of training at which the document is first
    read (null: never); starts: that of each reading.
    """
    n, digits = counts.count(), 3
    while n > bucket_rows * 16**digits and digits < 8:
        digits += 1
    bucket = F.substring("order", 1, digits).alias("bucket")
    per_bucket = stage(counts.groupBy("key", bucket).agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    per_source = targets(per_bucket.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    kinds = F.array(*(segments(s) for s in shapes))
    per_source = per_source.select("key", "source_size", "target", F.floor("target").cast("long").alias("goal"), F.sum("source_size").over(Window.partitionBy(F.lit(0))).alias("all_size"), F.element_at(kinds, (F.col("rank") % len(shapes) + 1).cast("int")).alias("parts"))
    running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = per_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).join(per_source, "key").drop("bucket_size")
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("bucket", bucket).join(spans, ["key", "bucket"])
    out = out.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("rounds", rounds).withColumn("rest", F.col("goal") - F.col("rounds") * F.col("source_size"))
    cut = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    out = out.withColumn("taken", F.col("rounds") * F.col("size") + cut)
    out = out.withColumn("copies", (F.col("rounds") + F.when((cut > 0) & (2 * cut >= F.col("size")), 1).otherwise(0)).cast("int"))
    reads = (F.col("rounds") + F.when(cut > 0, 1).otherwise(0)).cast("int")
    at = lambda k: F.floor(time_of((k * F.col("source_size") + F.col("start")) / F.col("goal"), F.col("parts")) * F.col("all_size")).cast("long")
    out = out.withColumn("starts", F.when((reads > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), F.greatest(reads - 1, F.lit(0))), at)))
    return out.withColumn("position", F.element_at("starts", 1)).drop("bucket", "bucket_start", "parts", "goal", "rounds", "rest", "start")


def range_sorted(plan: DataFrame, position: str = "position") -> DataFrame:
    """Sorts by position over all partitions; rows without one stand last, spread by their order."""
    late = F.col("all_size") + F.conv(F.substring("order", 1, 12), 16, 10).cast("long")
    return plan.withColumn("_at", F.coalesce(F.col(position), late)).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position; in training order."""
    counts = stage(sized(docs).select("doc_id", "key", "order", "size"), "mix-sizes")
    plan = placed(counts, counts, **how).select("doc_id", "order", "size", "source_size", "all_size", "target", "taken", "copies", "position")
    return range_sorted(stage(plan, "mix-plan")).drop("order", "all_size")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, whole, as often as it reads them, in training order; the columns of docs.

    A document whose last reading is cut counts if half of it is read. A document without words stays once where its
    source is read at all.
    """
    rows = sized(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"))
    counts = stage(rows.select("doc_id", "key", "order", "size"), "mix-sizes")
    plan = placed(rows.drop("source", "text"), counts, **how)
    # nothing to read in it, so nothing of it is over its target
    empty = (F.col("size") == 0) & ((F.col("target") > 0) | (F.col("source_size") == 0))
    plan = plan.withColumn("starts", F.when(empty, F.array(F.lit(0).cast("long"))).otherwise(F.slice("starts", 1, F.col("copies"))))
    read = plan.select("row", "order", "all_size", F.explode("starts").alias("position"))
    return range_sorted(read).select("row.*")


#: The query's curriculum: shapes go round with the sources' order, their integrals follow the weights.
CURRICULUM = (RISING, FALLING, FLAT)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0, shapes=CURRICULUM)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
