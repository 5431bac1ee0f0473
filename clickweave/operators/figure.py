"""The category graph as a figure: hubs bounded, layers by depth, few crossing edges.

A figure holds a few thousand nodes whatever the graph's size: the trimmed graph has a bounded core, and of each node the `shown` children that have most
children themselves are drawn, of its parents likewise; ties go to the smaller id. The other children, with all below them, become one node
"children of <id>" that says how many it stands for, and a node says how many of its parents aren't drawn. So nothing is left out without a note.
Nodes that no root reaches, around a cycle, have no place in layers and aren't in the figure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.shared import counted, discard, stored

from .tree import trimmed_edges

#: Children and parents of a node that are drawn, and pairs of sweeps at most.
SHOWN, SWEEPS = 12, 6


def bounded(links: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Edges (src, dst as text, n) of the figure; n is the number of children that the edge stands for.

    The ranks are limits for each key, so every map task sends `shown` rows of a hub on, not all of them.
    """
    below = links.groupBy("src").agg(F.count("*").alias("below"))
    weighed = links.join(below.select(F.col("src").alias("dst"), F.col("below").alias("of_dst")), "dst", "left").join(below.withColumnRenamed("below", "of_src"), "src")
    children = Window.partitionBy("src").orderBy(F.desc(F.coalesce("of_dst", F.lit(0))), "dst")
    parents = Window.partitionBy("dst").orderBy(F.desc("of_src"), "src")
    best = weighed.withColumn("rank", F.row_number().over(children)).filter(F.col("rank") <= shown).select("src", "dst")
    best = best.join(weighed.withColumn("rank", F.row_number().over(parents)).filter(F.col("rank") <= shown).select("src", "dst"), ["src", "dst"])
    as_text = lambda c: F.col(c).cast("string").alias(c)
    rest = below.filter(F.col("below") > shown).select(as_text("src"), F.concat(F.lit("children of "), "src").alias("dst"), (F.col("below") - shown).alias("n"))
    return best.select(as_text("src"), as_text("dst"), F.lit(1).cast("long").alias("n")).unionByName(rest)


def ranked(placed: DataFrame, *order) -> DataFrame:
    """node, y and x, the place in its layer."""
    return placed.select("node", "y", F.row_number().over(Window.partitionBy("y").orderBy(*order)).alias("x"))


def layers(tops: DataFrame, links: DataFrame) -> DataFrame:
    """node, y (fewest edges from a top) and x: each layer in the order of the mean place of a node's parents in the layer above, then of nodes. A round for each layer."""
    front = stored(ranked(tops.select("node").distinct().withColumn("y", F.lit(0)), "node"))
    parts = [front]
    while True:
        seen = reduce(DataFrame.unionByName, parts).select("node")
        ahead = front.join(links, front.node == links.src).groupBy(F.col("dst").alias("node")).agg(F.avg("x").alias("mean")).join(seen, "node", "left_anti")
        front, n = counted(ranked(ahead.withColumn("y", F.lit(len(parts))), "mean", "node"))
        parts.append(front)
        if not n:
            break
    found = stored(reduce(DataFrame.unionByName, parts))
    for part in parts:
        discard(part)
    return found


def between_layers(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges from a layer to the next one: y of the upper, ends (src, dst) and their places (a, b)."""
    up, down = placed.toDF("src", "y", "a"), placed.toDF("dst", "z", "b")
    return links.select("src", "dst").join(up, "src").join(down, "dst").filter("z = y + 1").select("y", "src", "dst", "a", "b")


def crossings(links: DataFrame, placed: DataFrame) -> DataFrame:
    """n_crossings: pairs of edges between two layers that cross; one row.

    Two edges cross if their upper ends are in one order and their lower in the other. Of two different numbers, the smaller has a 0 in the highest
    bit that differs; so for each bit, running sums over the edges that agree in all higher ones count the pairs, without making any.
    """
    bits = between_layers(links, placed).select("y", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("bit"))
    bits = bits.select("y", "a", "bit", F.expr("shiftright(shiftright(b, bit), 1)").alias("higher"), F.expr("shiftright(b, bit) & 1").alias("one"))
    to_the_left = Window.partitionBy("y", "bit", "higher").orderBy("a").rangeBetween(Window.unboundedPreceding, -1)
    larger = bits.withColumn("larger", F.sum("one").over(to_the_left)).filter("one = 0")
    return larger.agg(F.coalesce(F.sum("larger"), F.lit(0)).cast("long").alias("n_crossings"))


def swept(links: DataFrame, placed: DataFrame, down: bool) -> DataFrame:
    """`placed` with each layer in the order of the mean place of a node's neighbours in the layer above (`down`) or below; all layers at once."""
    width = placed.groupBy("y").agg(F.max("x").alias("width"))
    part = F.broadcast(width)  # a row for each layer of a figure
    share = placed.join(part, "y").select("node", "y", "x", ((F.col("x") - 0.5) / F.col("width")).alias("share"))
    ends = between_layers(links, placed)
    node, other = ("dst", "src") if down else ("src", "dst")
    means = ends.select(F.col(node).alias("node"), F.col(other).alias("other")).join(share.select(F.col("node").alias("other"), F.col("share").alias("of_other")), "other")
    means = means.groupBy("node").agg(F.avg("of_other").alias("mean"))
    return ranked(share.join(means, "node", "left"), F.coalesce("mean", "share"), "x")


def arranged(links: DataFrame, placed: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """The arrangement with fewest crossings of the given one and those of up to `sweeps` sweeps up and down, the earliest of equal ones. Gives a stored table and deletes `placed`."""
    best, fewest = placed, crossings(links, placed).first()[0]
    now = placed
    for k in range(2 * sweeps):
        if not fewest:
            break
        after = stored(swept(links, now, down=k % 2 == 1))
        n = crossings(links, after).first()[0]
        old = {now, best}
        if n < fewest:
            best, fewest = after, n
        now = after
        for df in old - {now, best}:
            discard(df)
    if now is not best:
        discard(now)
    return best


def figure_edges(tree: DataFrame, most: int = 200, kept: int = 150, shown: int = SHOWN) -> tuple[DataFrame, DataFrame]:
    """The trimmed graph's edges and the figure's, both stored."""
    links = stored(trimmed_edges(tree, most, kept))
    return links, stored(bounded(links, shown))


def figure_of(links: DataFrame, drawn: DataFrame, shown: int = SHOWN) -> DataFrame:
    """node (text), x and y, n (the children that it stands for, 1 for a node of the graph), size, labelled, and parents_left_out. Stored.

    `links` are the graph's edges, `drawn` those that `bounded` leaves of them; both are read several times.
    """
    tops = links.select("src").distinct().join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    placed = arranged(drawn, layers(tops.select(F.col("src").cast("string").alias("node")), drawn))
    out = links.groupBy(F.col("src").cast("string").alias("node")).agg(F.count("*").alias("out"))
    above = links.groupBy(F.col("dst").cast("string").alias("node")).agg(F.count("*").alias("above"))
    rest = drawn.filter(F.col("dst").startswith("children of ")).select(F.col("dst").alias("node"), "n")
    nodes = placed.join(out, "node", "left").join(above, "node", "left").join(rest, "node", "left")
    children = F.coalesce("out", F.lit(0))
    found = stored(nodes.select(
        "node", "x", "y", F.coalesce("n", F.lit(1)).alias("n"),
        F.greatest(F.lit(8.0), F.least(F.lit(25.0), 8 + 0.5 * children)).alias("size"),
        ((children >= 5) | F.col("n").isNotNull()).alias("labelled"),
        F.greatest(F.lit(0), F.coalesce("above", F.lit(0)) - shown).alias("parents_left_out"),
    ))
    discard(placed)
    return found


def figure(tree: DataFrame, most: int = 200, kept: int = 150, shown: int = SHOWN) -> DataFrame:
    """`figure_of` the trimmed graph of a category tree."""
    links, drawn = figure_edges(tree, most, kept, shown)
    found = figure_of(links, drawn, shown)
    discard(links)
    discard(drawn)
    return found


def crossings_by_id_and_in_figure(tree: DataFrame, most: int = 200, kept: int = 150, shown: int = SHOWN) -> DataFrame:
    """by_id, in_figure: crossings of the figure's edges if each layer is in the order of ids, and as it is arranged; one row."""
    links, drawn = figure_edges(tree, most, kept, shown)
    placed = figure_of(links, drawn, shown).select("node", "y", "x")
    by_id = crossings(drawn, ranked(placed, "node")).withColumnRenamed("n_crossings", "by_id")
    return by_id.join(F.broadcast(crossings(drawn, placed).withColumnRenamed("n_crossings", "in_figure")), F.lit(True))  # one row each
