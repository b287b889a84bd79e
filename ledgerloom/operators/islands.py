"""Islands: parts of a table of payments that no test for the same payment can join, so an ordered pass may take them apart.

Two payments of one user, amount and direction can be the same only within `gap_ms` of each other or by their references. Rows of one 12-hour bucket are near each other; neighbouring buckets are joined
where the step between them is no wider than the gap, which a window over buckets tells, not over rows. What then shares a reference (one being the beginning or end of the other), or another key, is joined to components.

Everything is keyed by 64-bit hashes; two keys with one hash only make one island of two, which costs nothing but width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes in the links (a, b): the least node that links lead to. Roots fall until a round changes none; a round is a partial minimum over neighbours and a step to the root's root."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    roots = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    while True:
        roots = written(roots, "roots")
        met = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        best = roots.join(met, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = written(best.join(up, "root").select("node", "was", F.least("root", "up").alias("root")), "roots")
        roots = moved.select("node", "root")
        if not moved.filter("root != was").limit(1).count():
            return roots


def reference_parts(ref: Column, least: int) -> Column:
    """All beginnings and ends of a reference with at least `least` characters, itself included."""
    sizes = F.sequence(F.lit(least), F.greatest(F.length(ref), F.lit(least)))
    return F.array_distinct(F.concat(F.transform(sizes, lambda n: F.left(ref, n)), F.transform(sizes, lambda n: F.right(ref, n))))


def with_islands(rows: DataFrame, group: list[str], gap_ms: int, least_reference: int, keys: list[Column] | None = None) -> DataFrame:
    """`rows` with `island`. They have the group's columns, `ms`, and `ref` (null or at least `least_reference` long); `keys` are columns whose equal values join islands of any group."""
    placed = rows.withColumn("__g", F.xxhash64(*group)).withColumn("__b", F.floor(F.col("ms") / gap_ms).cast("long"))
    spans = placed.groupBy("__g", "__b").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    by_group = W.partitionBy("__g").orderBy("__b")
    before = F.lag("hi").over(by_group)
    first = spans.withColumn("first", F.when(before.isNull() | (F.col("lo") - before > gap_ms), F.col("__b")))
    at = F.last("first", ignorenulls=True).over(by_group.rowsBetween(W.unboundedPreceding, 0))
    nodes = written(first.select("__g", "__b", F.xxhash64("__g", at).alias("node")), "islands")
    named = written(placed.join(nodes, ["__g", "__b"]), "placed")
    # what joins islands: values that rows of several of them hold
    refs = named.filter("ref is not null").select("__g", "ref", "node").distinct()
    parts = refs.select("node", F.explode(F.transform(reference_parts(F.col("ref"), least_reference), lambda p: F.xxhash64("__g", p))).alias("v"))
    touched = parts.join(refs.select(F.xxhash64("__g", "ref").alias("v")).distinct(), "v", "left_semi").select("v", "node")
    for k in keys or []:
        touched = touched.union(named.filter(k.isNotNull()).select(F.xxhash64("user_id", k).alias("v"), "node"))
    several = touched.groupBy("v").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b != most").select("v", "b")
    links = written(touched.join(several, "v").filter("node != b").select(F.col("node").alias("a"), "b").distinct(), "links")
    out = named.drop("__g", "__b")
    if not links.limit(1).count():
        return out.withColumnRenamed("node", "island")
    return out.join(components(links), "node", "left").withColumn("island", F.coalesce("root", "node")).drop("node", "root")
