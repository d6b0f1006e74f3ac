"""Small graph steps as joins: chains followed to their end, connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def followed(steps: DataFrame, start: str = "code", to: str = "new_code") -> DataFrame:
    """(start, end, hops, cycle) of a table with one step for each ``start``: where its chain ends and after how many steps.

    Pointers double, so a chain of n steps takes log2(n) joins.  A chain that runs into a cycle has no end (null)."""
    now = staged(steps.select(F.col(start).alias("x"), F.col(to).alias("y"), F.lit(1).cast("long").alias("hops"))
                 .where("x is not null and y is not null").dropDuplicates(["x"]), "chain")
    rounds = math.ceil(math.log2(now.count() + 1)) + 1
    for _ in range(rounds):
        ahead = now.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("hops").alias("more"))
        joined = now.join(ahead, "y", "left")
        new = staged(joined.select("x", F.coalesce("z", "y").alias("y"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                                   F.col("z").isNotNull().alias("moved")), "chain")
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    ends = now.join(now.select(F.col("x").alias("y"), F.lit(True).alias("goes_on")), "y", "left")
    cycle = F.coalesce("goes_on", F.lit(False))
    return ends.select(F.col("x").alias(start), F.when(~cycle, F.col("y")).alias("end"), F.when(~cycle, F.col("hops")).alias("hops"), cycle.alias("cycle"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge table; a component's name is its smallest node.

    Every node takes the smallest name among itself and its neighbours, then the name's own name, until nothing changes.
    Names are partial minima, so a node with very many neighbours is no hot group."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = staged(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    names = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("name")), "names")
    while True:
        near = both.join(names.select(F.col("u").alias("v"), F.col("name").alias("other")), "v").groupBy("u").agg(F.min("other").alias("low"))
        lower = names.join(near, "u").select("u", F.least("name", "low").alias("name"), F.col("name").alias("was"))
        hop = names.select(F.col("u").alias("name"), F.col("name").alias("next"))
        new = staged(lower.join(hop, "name").select("u", F.least("name", "next").alias("name"), "was"), "names")
        names = new.drop("was")
        if new.where("name <> was").isEmpty():
            return names.select(F.col("u").alias("node"), F.col("name").alias("component"))
