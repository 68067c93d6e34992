"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import written


def _star(pairs: DataFrame, keep) -> DataFrame:
    """pairs: u, v. Hangs the kept neighbours of u on the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.filter(keep).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v (long, no nulls). Returns id, root for every id with an edge; root is the least id of its component.

    Each round is a fixed number of shuffles of at most as many edges as before, and is written to the shared folder; rounds grow
    with the logarithm of a component's size. The rounds end when the edges are those of the round before; only a count reaches the driver.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        if before is not None and before.count() == now.count() and not now.join(before, ["u", "v"], "left_anti").limit(1).count():
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), F.col("v") > F.col("u"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    raise RuntimeError(f"no components after {max_rounds} rounds")
