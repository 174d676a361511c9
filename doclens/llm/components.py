"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.store import materialise


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, component (the smallest id reachable, itself included) of each id in edges(a bigint, b bigint).

    Distributed union-find: each round hooks every vertex to the neighbour that comes first by a hash of its id,
    shortens the paths, and contracts the edges to what they now point to; the number of vertices falls at least by
    half a round. Hashing keeps chains short whatever the order of ids. Edges with a null end, loops and repeated
    edges count for nothing, though the ends of a loop are given, each as its own component. Each round's tables are written
    to the shared folder, so the lineage stays short and a lost executor repeats one round at most."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct()
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialise(e, f"{name}-edges")
    parents = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("n"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        hooks = materialise(first.select(F.col("a").alias("id"), F.least("n", own)["id"].alias("parent")), f"{name}-hooks")
        for _ in range(2):
            up = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("grandparent"))
            hooks = hooks.join(up, "parent").select("id", F.col("grandparent").alias("parent"))
        hooks = materialise(hooks, f"{name}-parents")
        if parents is None:
            parents = hooks
        else:
            next_ = hooks.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
            parents = materialise(parents.join(next_, "parent", "left").select("id", F.coalesce("root", "parent").alias("parent")), f"{name}-roots")
        of = lambda c: hooks.select(F.col("id").alias(c), F.col("parent").alias(f"{c}_root"))
        e = e.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
        e = materialise(e.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), f"{name}-edges")
    if parents is None:
        return ends.select("id", F.col("id").alias("component"))
    least = parents.groupBy("parent").agg(F.min("id").alias("component"))
    labels = parents.join(least, "parent").select("id", "component")
    return materialise(ends.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component")), f"{name}-labels")
