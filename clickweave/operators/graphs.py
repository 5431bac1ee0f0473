"""Longest ways down from roots in graphs whose nodes may have several parents and lie on cycles.

A way ends where a node repeats on it; that node counts with its level. A way never comes back to a strongly connected part that it left, so only inside
such a part does the way walked so far matter. Outside, the longest way is a sum over layers: a node is done when all its parents are, and sends its
depth, by root, to its children. When no node is ready but some wait, the rest holds cycles: its strongly connected parts are found by colours
(the largest node that reaches a node, forward; then the nodes of that colour that reach back to it), and each part is a node from then on.

Rounds are the layers and, for cycles, the diameter of the parts. Ways are listed inside a part alone, where finding the longest is a hard problem anyway.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clickweave.shared import counted, discard, stored


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root and level: the fewest edges (src, dst) from a `start` node, and the smallest such start at its last level; a round for each level."""
    front = stored(start.select("node").distinct().select("node", F.col("node").alias("root"), F.lit(0).alias("level")))
    parts, level = [front], 0
    while True:
        level += 1
        seen = reduce(DataFrame.unionByName, parts).select("node")
        ahead = front.select(F.col("node").alias("src"), "root").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("root"))
        front, n = counted(ahead.join(seen, "node", "left_anti").select("node", "root", F.lit(level).alias("level")))
        if not n:
            return reduce(DataFrame.unionByName, parts)
        parts.append(front)


def largest_above(edges: DataFrame) -> DataFrame:
    """node and colour: the largest node from which a way leads to it, itself included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found, before = stored(ends.withColumn("colour", F.col("node"))), None
    while True:
        sent = edges.join(found, edges.src == found.node).select(F.col("dst").alias("node"), "colour")
        seen = Observation()
        after = stored(found.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")), seen, total=F.sum(F.col("colour").cast("decimal(38, 0)")))
        discard(found)
        found = after
        if seen.get["total"] == before:  # colours only grow
            return found
        before = seen.get["total"]


def strong_parts(edges: DataFrame) -> DataFrame:
    """node and part of the nodes of `edges` (src, dst) that lie on cycles; the part is its largest node."""
    left, parts = stored(edges.select("src", "dst").distinct()), []
    while True:
        colours = largest_above(left)
        a, b = (colours.select(F.col("node").alias(n), F.col("colour").alias(f"{n}_colour")) for n in ("src", "dst"))
        inside = stored(left.join(a, "src").join(b, "dst").filter("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        part = stored(reached(colours.filter("node = colour"), back).select("node").join(colours, "node").select("node", F.col("colour").alias("part")))
        parts.append(part)
        left, n = counted(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
        if not n:
            found = reduce(DataFrame.unionByName, parts)
            looped = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
            several = found.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
            return stored(found.join(several, "part", "left_semi").unionByName(found.join(looped, "node", "left_semi")).select("node", "part").distinct())


def ways_inside(entries: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the longest ways without a repeated node from each entry through `inner` edges: entry, node, steps; and entry, over: steps with a repeated last node."""
    front = stored(entries.select(F.col("node").alias("entry"), "node", F.array("node").alias("way")))
    ways, overs = [front], []
    while True:
        ahead = front.join(inner, front.node == inner.src).select("entry", F.col("dst").alias("node"), "way")
        again = F.array_contains("way", F.col("node"))
        overs.append(ahead.filter(again).select("entry", F.size("way").alias("over")))
        front, n = counted(ahead.filter(~again).withColumn("way", F.array_append("way", F.col("node"))))
        if not n:
            break
        ways.append(front)
    steps = reduce(DataFrame.unionByName, ways).groupBy("entry", "node").agg(F.max(F.size("way") - 1).alias("steps"))
    return stored(steps), stored(reduce(DataFrame.unionByName, overs).groupBy("entry").agg(F.max("over").alias("over")))


def longest_ways(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root and depth of the longest way down from each of `roots` (root) over `edges` (src, dst)."""
    given = stored(edges.select("src", "dst").distinct())
    alive = reached(roots.select(F.col("root").alias("node")), given)
    whole = stored(given.join(alive.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b")))
    left, parts, inner = whole, None, None
    entries = stored(roots.select(F.col("root").alias("node"), "root", F.lit(0).alias("depth"), F.col("root").alias("part")).distinct())
    found = []
    while True:
        ready, n = counted(entries.join(left.select(F.col("b").alias("part")).distinct(), "part", "left_anti"))
        if not n:
            if entries.isEmpty():
                return stored(reduce(DataFrame.unionByName, [f.select("root", "depth") for f in found]).groupBy("root").agg(F.max("depth").alias("depth"))) if found else entries.select("root", "depth")
            parts = strong_parts(left)
            named = lambda n, to: parts.select(F.col("node").alias(n), F.col("part").alias(to))
            both = left.select("src", "dst").join(named("src", "pa"), "src", "left").join(named("dst", "pb"), "dst", "left").select("src", "dst", F.coalesce("pa", "src").alias("a"), F.coalesce("pb", "dst").alias("b"))
            inner = stored(both.filter("a = b").select("src", "dst"))
            left = stored(both.filter("a <> b"))
            entries = stored(entries.drop("part").join(named("node", "part"), "node", "left").select("node", "root", "depth", F.coalesce("part", "node").alias("part")))
            continue
        found.append(ready)
        outs = ready
        if parts is not None:
            steps, overs = ways_inside(ready.select("node").distinct(), inner)
            entry = ready.select(F.col("node").alias("entry"), "root", "depth", "part")
            outs = stored(entry.join(steps, "entry").groupBy("node", "root", "part").agg(F.max(F.col("depth") + F.col("steps")).alias("depth")))
            found += [outs, stored(entry.join(overs, "entry").select("root", (F.col("depth") + F.col("over")).alias("depth")))]
        sent = left.join(outs.select(F.col("node").alias("src"), "root", "depth"), "src").select(F.col("dst").alias("node"), "root", (F.col("depth") + 1).alias("depth"), F.col("b").alias("part"))
        waiting = entries.join(ready.select("part").distinct(), "part", "left_anti").select("node", "root", "depth", "part")
        entries = stored(waiting.unionByName(sent).groupBy("node", "root", "part").agg(F.max("depth").alias("depth")))
        left = stored(left.join(ready.select(F.col("part").alias("a")).distinct(), "a", "left_anti").select("src", "dst", "a", "b"))
