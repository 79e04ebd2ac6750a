"""Connected components of a link table, all on executors, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.patterns import looked_up
from sluice.plans import scratch


def _rooted(steps: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root: each jump doubles how far a pointer reaches."""
    while True:
        tops = steps.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        jump = looked_up(steps, tops, ["parent"], "left").select("node", F.coalesce("top", "parent").alias("parent"), F.col("top").isNotNull().alias("moved"))
        jump = scratch.keep(jump, "steps")
        if jump.where("moved").isEmpty():
            return steps
        steps = jump.select("node", "parent")


def _renamed(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Links between roots; those within one are gone."""
    for end in "ab":
        named = steps.select(F.col("node").alias(end), F.col("parent").alias("root"))
        edges = scratch.keep(looked_up(edges, named, [end], "left").withColumn(end, F.coalesce("root", end)).drop("root"), "ends")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component): each linked node's smallest reachable node.

    ``links`` has columns a and b. In each round every node with a smaller neighbour points to its smallest one,
    pointers are followed to their roots, and the links between roots go on to the next round. A root that no
    neighbour points to has a smaller neighbour in the next round, so two rounds leave half of the nodes at most,
    and pointers of length n end in log2(n) jumps: there is no limit of rounds. Neighbours are pre-aggregated before
    the shuffle and hot nodes are renamed by a broadcast, so a hub costs one row a task. Tables go to the shared
    scratch folder, so a lost executor repeats one step. No links give an empty table; links to null are ignored;
    repeated links change nothing; a node that is only linked to itself has no row.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        steps = both.groupBy("node").agg(F.min("near").alias("parent")).where("parent < node")
        rounds.append(_rooted(scratch.keep(steps, "steps")))
        edges = scratch.keep(_renamed(edges, rounds[-1]), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop().select("node", F.col("parent").alias("component"))
    while rounds:
        later = found.select(F.col("node").alias("parent"), "component")
        steps = looked_up(rounds.pop(), later, ["parent"], "left").select("node", F.coalesce("component", "parent").alias("component"))
        found = scratch.keep(steps.union(found), "found")
    return scratch.keep(found.union(found.select("component", "component").distinct()), "components")
