"""Mixing sources to target weights by entropy balancing.

Every document has a size (its words). Sources get token targets from weights, each held at `most` times the source's
own size, and the mix repeats or leaves out documents so that each source's words come near its target.

The rates solve: least sum over documents of r ln r - r + 1, the entropy distance from taking every document once, such that each
source's words meet its target and no rate passes `most`. The convex dual has one multiplier m per source, and the rates are the
exponential tilt r = min(most, exp(m * size / scale)), scale being the source's size-weighted mean size, so documents of a source
differ in rate by their size. Newton steps solve the dual for all sources at once. Each step aggregates gradient and Hessian, the sums of
size * r and of size * size / scale * r over the documents below the bound, by source from the counts of (source, size) groups, and
stays in a bracket that shrinks around the root (a step that leaves it is halved). Steps end when every source is within `TOLERANCE` of
its target; a source whose target is `most` times its size has rate `most`, no root being needed.

Rounding into copies is systematic: in a source's documents ordered by (size, slot, id), with running rates R, the i-th gets
floor(R[i] + 1/2) - floor(R[i-1] + 1/2) copies, the floor or ceiling of its rate. As sizes ascend the taken words are within about one half
of the source's largest document of the target. What is then missing or over is settled with the smallest documents of the
source, again by counts of groups. The order's rank comes from counts of (source, size, slot) groups plus a rank within such a group, so
no source, and no group of copies, is ranked by one task: a window holds the slots of a size, the distinct sizes of a source, or a group.

Only DataFrame functions are used. Edge cases: null or blank texts have size 0 and take 0 words; a null source is a source,
the last; an empty table gives no rows; if all sizes are 0, targets are 0; a rate of exactly `most` takes each document
`most` times; repeated rows are separate documents; of repeated ids either may get the extra copy, their results being
equal as rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import word_count, written

#: Newton steps at most, and the relative distance from the target at which they end.
STEPS, TOLERANCE = 60, 1e-13
#: Slots that split documents of one source and one size, such as a large group of copies.
SLOTS = 65_536


def numbered(keys: DataFrame, column: str) -> DataFrame:
    """Adds `place`, from 0 in ascending order of a distinct column, nulls last. Ranges are ranked apart and then offset; only one count a range meets in one task."""
    held = written(keys.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col(column).isNull().cast("int")).alias("_null"), F.min(column).alias("_low"))
    before = Window.orderBy("_null", "_low").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_range").orderBy(F.col(column).asc_nulls_last())
    return held.join(offsets, "_range").withColumn("place", F.col("_before") + F.row_number().over(own) - 1).drop("_range", "_before")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """totals: source, total. Adds target: weights go round the sources in order; a target stops at most * total, and the excess is shared anew by weight."""
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(numbered(totals, "source").withColumn("weight", turn).withColumn("cap", F.col("total") * F.lit(float(most))), "sources")
    asked = (ranked.agg(F.sum("total").alias("t")).first()["t"] or 0) * share
    level = 0.0
    while True:  # each pass caps more sources or ends
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        free = ranked.agg(F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(F.when(full, F.col("cap"))).alias("c")).first()
        if not free["w"]:
            break
        new = (asked - (free["c"] or 0.0)) / free["w"]
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap")))


def exact(column):
    """A sum of doubles that does not depend on their order, to 12 decimal places."""
    return F.sum(column.cast("decimal(38,12)")).cast("double")


def tilt(multiplier, size, scale, most: float):
    """The rate of documents of a size."""
    return F.least(F.lit(float(most)), F.exp(multiplier * size / scale))


def balanced(sources: DataFrame, sizes: DataFrame, most: float, steps: int = STEPS) -> DataFrame:
    """sources: source, total, target. sizes: source, size, m (documents of that size). Adds multiplier and scale; the multiplier is null where every rate is `most`, or 0."""
    held = sizes.filter("size > 0").select(F.col("source").alias("_s"), F.col("size").cast("double").alias("_z"), F.col("m").cast("double").alias("_m"))
    moments = held.groupBy("_s").agg(exact(F.col("_z") * F.col("_z") * F.col("_m")).alias("_q"), F.min("_z").alias("_least"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    total, target = F.col("total").cast("double"), F.col("target")
    open_ = (total > 0) & (target > 0) & (target < F.lit(float(most)) * total)
    now = sources.join(moments, same, "left").drop("_s").withColumn("scale", F.col("_q") / total)
    reach = F.col("scale") / F.col("_least")
    now = now.withColumn("multiplier", F.when(open_, F.lit(0.0))).withColumn("low", F.when(target < total, -F.log(total / target) * reach - 1).otherwise(F.lit(0.0))).withColumn("high", F.when(target > total, F.log(F.lit(float(most))) * reach).otherwise(F.lit(0.0)))
    now = written(now.select("source", "place", "total", "target", "scale", "multiplier", "low", "high"), "newton")
    for _ in range(steps):
        rate = tilt(F.col("multiplier"), F.col("_z"), F.col("scale"), most)
        words = F.col("_z") * F.col("_m") * rate
        bent = F.when(rate < most, words * F.col("_z") / F.col("scale")).otherwise(F.lit(0.0))
        sums = held.join(now, same).filter("multiplier is not null").groupBy("_s").agg(exact(words).alias("_words"), exact(bent).alias("_bent"))
        met = now.join(sums, same, "left").withColumn("_gap", F.col("_words") - target)
        far = F.abs("_gap") > target * TOLERANCE
        low, high = F.when(F.col("_gap") < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(F.col("_gap") > 0, F.col("multiplier")).otherwise(F.col("high"))
        met = met.withColumn("low", low).withColumn("high", high).withColumn("_to", F.col("multiplier") - F.try_divide("_gap", "_bent"))
        step = F.when((F.col("_to") > F.col("low")) & (F.col("_to") < F.col("high")), F.col("_to")).otherwise((F.col("low") + F.col("high")) / 2)
        now = written(met.select("source", "place", "total", "target", "scale", F.when(far, step).otherwise(F.col("multiplier")).alias("multiplier"), "low", "high", F.coalesce(far, F.lit(False)).alias("far")), "newton")
        if not now.filter("far").limit(1).count():
            break
        now = now.drop("far")
    return now.select("source", "total", "target", "scale", "multiplier")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, slots: int = SLOTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text, source, and columns to carry along. Returns those, doc_id, source, size, source_size, target, rate, copies, taken, one row per row of docs."""
    sized = written(docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size")), "sizes")
    slot = F.coalesce(F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(slots)), F.lit(0)).alias("slot")
    rows = sized.select("doc_id", "source", *carry, "size", slot)
    groups = written(rows.groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("n")), "groups")
    sizes = written(groups.groupBy("source", "size").agg(F.sum("n").alias("m")), "source-sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("total"))
    sources = written(balanced(source_targets(totals, weights, share, most), sizes, most), "targets")
    # The running rate where each (source, size, slot) group begins: over sizes of a source, then over the slots of one size.
    whole = F.when((F.col("total") > 0) & (F.col("target") > 0), F.lit(float(most))).otherwise(F.lit(0.0))
    rate = F.coalesce(tilt(F.col("multiplier"), F.col("_z").cast("double"), F.col("scale"), most), whole)
    sizes = sizes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "m").join(sources, F.col("_s").eqNullSafe(F.col("source"))).withColumn("rate", rate)
    ascending = Window.partitionBy("_s").orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_s", "_z", "total", "target", "rate", F.coalesce(F.sum(F.col("rate") * F.col("m")).over(ascending), F.lit(0.0)).alias("_at"))
    within = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sizes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    starts = starts.select("_s", "_z", F.col("slot").alias("_t"), "total", "target", "rate", "_at", "_in")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("doc_id")))
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("slot") == F.col("_t")))
    i = F.col("_in") + F.col("_rank")
    copies = F.least(F.floor(F.col("_at") + F.col("rate") * i + 0.5) - F.floor(F.col("_at") + F.col("rate") * (i - 1) + 0.5), F.ceil("rate")).cast("long")
    first = joined.withColumn("copies", copies).select("doc_id", "source", *carry, "size", "slot", F.col("total").alias("source_size"), "target", "rate", "copies")
    return settled(written(first, "copies"), carry)


def settled(rounded: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rounds a few of each source's smallest documents the other way (a copy stays the floor or ceiling of the rate), as many as fit in what is missing from, or over, its target."""
    taken = F.col("copies") * F.col("size")
    miss = rounded.groupBy("source").agg((F.max("target") - F.sum(taken)).alias("_miss"))
    rows = rounded.join(miss.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    up = (F.col("_miss") > 0) & (F.col("copies") < F.ceil("rate"))
    down = (F.col("_miss") < 0) & (F.col("copies") > F.floor("rate"))
    rows = rows.withColumn("_may", (F.col("size") > 0) & (up | down))
    groups = written(rows.filter("_may").groupBy("source", "size", "slot").agg(F.count(F.lit(1)).alias("_n"), F.max("_miss").alias("_room")), "movable")
    ascending = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = groups.groupBy("source", "size").agg(F.sum("_n").alias("_m")).withColumn("_under", F.coalesce(F.sum(F.col("size") * F.col("_m")).over(ascending), F.lit(0)))
    sizes = sizes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_under")
    within = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_in", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(within), F.lit(0)))
    groups = groups.join(sizes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    left = F.abs("_room") - F.col("_under") - F.col("_in")
    groups = groups.withColumn("_turn", F.least(F.col("_n"), F.floor(left / F.col("size")))).filter("_turn > 0")
    groups = groups.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("slot").alias("_t"), "_turn")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot", "_may").orderBy("doc_id"))
    rows = rows.withColumn("_rank", rank).join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("slot") == F.col("_t")), "left")
    turned = F.col("_may") & (F.col("_rank") <= F.coalesce(F.col("_turn"), F.lit(0)))
    rows = rows.withColumn("copies", F.col("copies") + F.when(turned, F.signum("_miss").cast("long")).otherwise(F.lit(0)))
    return rows.select("doc_id", "source", *carry, "size", "source_size", "target", "rate", "copies", taken.alias("taken"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
