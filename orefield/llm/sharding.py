"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of keys gives quantile boundaries of many
narrow ranges; ranges that turn out overfull are sampled again and subdivided, down to one key. Inside a range a window
gives running bytes and ranks, a table of one row per range makes them global, and shard boundaries fall at equal
running bytes. Equal texts are neighbours: a group of them that a boundary would cut goes whole to one side while
it holds less than 1/16 of a shard, and is cut otherwise, so no group can overfill a shard.

The number of ranges follows the rows and bytes (RANGE_ROWS, RANGE_BYTES), and with it the length of the boundary list, 16 bytes a range.

Defined cases: null text counts as no bytes; doc_ids of any type: those that are no integers are ordered by a hash of their text, null ones stand before all; repeated rows stand beside each other; a very
long text is one record, which no cut divides, so its shard is over by as much as it; an empty table gives no rows; more shards than rows leave shards empty; where documents are returned, columns
of theirs named size, shard or slot are kept as size_input, shard_input and slot_input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, utf8

#: Ranges per shard that the first sample aims at, sample keys per range, and the load over which a range is subdivided.
RANGES_PER_SHARD, SAMPLE_PER_RANGE, OVERFULL = 16, 24, 2.0
#: Groups of equal texts up to this share of a shard are never cut.
WHOLE_GROUP = 1 / 16
RANGE_ROWS, RANGE_BYTES = 1 << 22, 1 << 30
LEAST = -(1 << 63)


def number_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string").try_cast("long"), F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("string"))), F.lit(LEAST))


def keyed(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    body = utf8(F.col("text"))
    return docs.select(*(extra or []), F.col("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"), number_of(F.col("doc_id")).alias("d"))


def lookup(bounds: list[tuple[int, int]], h: Column, d: Column) -> Column:
    """How many of the sorted boundary keys are at most (h, d): binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    hs, ds = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))  # folded to a constant

    def step(found: Column, by: Column) -> Column:
        at = found + by
        x, y = F.get(hs, at - 1), F.get(ds, at - 1)  # null past the end: not taken
        return F.when((x < h) | ((x == h) & (y <= d)), at).otherwise(found)

    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), step)


def splitters(rows: DataFrame, ranges: int, per_range: int = SAMPLE_PER_RANGE) -> tuple[list[tuple[int, int]], int]:
    """Boundary keys of ranges with near equal load, where a row's load is its share of the bytes plus its share of the rows.

    Each round samples keys with a chance that follows their load (about per_range keys a range, whatever the input's
    size) and takes quantiles; ranges over OVERFULL times the mean are sampled anew by themselves and subdivided.
    """
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    if not total.n:
        return [], 0
    ranges = max(ranges, -(-total.n // RANGE_ROWS), -(-total.b // RANGE_BYTES))
    load = (F.col("size") / total.b + F.lit(1.0) / total.n) / 2
    u = F.pmod(F.xxhash64("h", "d", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    bounds: list[tuple[int, int]] = []
    todo: dict[int, float] = {0: 1.0}
    while todo:  # ends: a range of more than one key always gets a boundary, or no boundary is new
        want = {r: max(2, round(x * ranges)) for r, x in todo.items()}
        rate = F.element_at(F.create_map(*(F.lit(v) for r in todo for v in (r, per_range * want[r] / todo[r]))), F.col("r"))
        inside = rows.withColumn("r", lookup(bounds, F.col("h"), F.col("d"))).where(F.col("r").isin(list(todo)))
        chance = F.least(F.lit(1.0), load * rate)
        sample = inside.where(u < chance).select("r", "h", "d", (load / chance).alias("w"))
        order = Window.partitionBy("r").orderBy("h", "d")
        cells = sample.withColumns({"c": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("w").over(Window.partitionBy("r"))})
        parts = F.element_at(F.create_map(*(F.lit(v) for r in todo for v in (r, want[r]))), F.col("r"))
        cells = cells.withColumn("q", F.floor((F.col("c") - F.col("w") / 2) * parts / F.col("t")))
        found = cells.groupBy("r", "q").agg(F.min(F.struct("h", "d")).alias("k")).where("q > 0").select("k.h", "k.d").collect()
        grown = sorted({*bounds, *((x.h, x.d) for x in found)})
        if grown == bounds:
            break
        bounds = grown
        full = rows.groupBy(lookup(bounds, F.col("h"), F.col("d")).alias("r")).agg(F.sum(load).alias("x"), F.min(F.struct("h", "d")).alias("lo"), F.max(F.struct("h", "d")).alias("hi"))
        todo = {x.r: x.x for x in full.where((F.col("x") > OVERFULL / ranges) & (F.col("lo") < F.col("hi"))).collect()}
    return bounds, total.b


def ordered(rows: DataFrame, bounds: list[tuple[int, int]], counts: DataFrame) -> DataFrame:
    """rows with at (bytes before the row) and rank (rows before it) in the whole order; counts: the same rows, staged."""
    spot = lookup(bounds, F.col("h"), F.col("d")).alias("r")
    per = counts.groupBy(spot).agg(F.sum("size").alias("rb"), F.count("*").alias("rn"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("r", F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("r").orderBy("h", "d", "size")
    # one row per range: ranges are bounded by the parameters
    return rows.withColumn("r", spot).join(F.broadcast(per), "r").withColumns({
        "at": F.col("b0") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rank": F.col("n0") + F.row_number().over(inside) - 1,
    }).drop("b0", "n0")


def cuts(placed: DataFrame, total: int, shards: int) -> list[int]:
    """The running bytes at which shards 1, 2, ... begin: equal steps, moved to the edge of a group of equal texts that they would cut unless the group is large."""
    ideal = total / shards
    marks = [ideal * k for k in range(1, shards)]
    over = F.array(*(F.lit(m) for m in marks))
    crossing = F.size(F.filter(over, lambda m: (m > F.col("at")) & (m < F.col("at") + F.col("size"))))
    hit = [x.h for x in placed.where(crossing > 0).select("h").distinct().collect()]  # at most one text a boundary
    groups = placed.where(F.col("h").isin(hit)).groupBy("h").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("size")).alias("hi")).collect()
    out = []
    for m in marks:
        g = next((g for g in groups if g.lo < m < g.hi and g.hi - g.lo <= WHOLE_GROUP * ideal), None)
        out.append(round(m) if g is None else g.lo if m - g.lo < g.hi - m else g.hi)
    return out


def assigned(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """placed rows with shard and slot; a row that a cut falls in goes where its middle is."""
    edges = F.array(*(F.lit(float(c)) for c in cuts(placed, total, shards))) if total and shards > 1 else F.array().cast("array<double>")
    out = placed.withColumn("shard", F.size(F.filter(edges, lambda m: m <= F.col("at") + F.col("size") / 2)).cast("int"))
    first = out.groupBy("shard").agg(F.min("rank").alias("rank0"))  # one row a shard
    return out.join(F.broadcast(first), "shard").withColumn("slot", (F.col("rank") - F.col("rank0")).cast("long")).drop("rank0")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`)."""
    rows = stage(keyed(docs), "shard-keys")
    bounds, total = splitters(rows, shards * RANGES_PER_SHARD)
    placed = stage(ordered(rows, bounds, rows), "shard-order")
    return assigned(placed, total, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents, range-partitioned, with size, shard and slot beside their columns."""
    body = keyed(docs, [F.struct(*docs.columns).alias("row")])
    rows = stage(keyed(docs), "shard-keys")
    bounds, total = splitters(rows, shards * RANGES_PER_SHARD)
    placed = stage(ordered(body, bounds, rows), "shard-order")
    new = ["size", "shard", "slot"]
    return assigned(placed, total, shards).select(*(F.col("row")[c].alias(f"{c}_input" if c in new else c) for c in docs.columns), *new)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)
