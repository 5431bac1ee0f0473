"""Category tree and its graph: roots, depths, children, degrees, a trimmed subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.shared import counted, discard, stored

from .graphs import longest_ways, reached


def roots(tree: DataFrame) -> DataFrame:
    return tree.filter("parentid IS NULL").select(F.col("categoryid").alias("root"))


def root_depths(tree: DataFrame) -> DataFrame:
    """root and depth: the longest way down from each root; a leaf root has 0. Runs at once and gives a stored table.

    A node that repeats on its own path counts with its level and isn't walked on. Neither the depth nor the number of nodes is limited.
    """
    rows = stored(tree.filter("categoryid IS NOT NULL").select("categoryid", "parentid").distinct())
    if rows.groupBy("categoryid").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        found = stored(depths_by_doubling(rows).groupBy("root").agg(F.max("depth").alias("depth")))
    else:
        found = longest_ways(roots(rows), edges(rows))
    discard(rows)
    return found


def depths_by_doubling(rows: DataFrame) -> DataFrame:
    """For a forest, where each node has one row: in each round a node's pointer leaps over that of the node it points to.

    The rounds are the logarithm of the depth. Nodes that no root reaches, below a missing node or around a cycle, drop out.
    """
    done_so_far = rows.filter("parentid IS NULL").select(F.col("categoryid").alias("node"), F.col("categoryid").alias("root"), F.lit(0).alias("depth"))
    below, waiting = counted(rows.filter("parentid IS NOT NULL").select(F.col("categoryid").alias("node"), F.col("parentid").alias("up"), F.lit(1).alias("steps")))
    while waiting:
        above = done_so_far.select(F.col("node").alias("up"), "root", F.col("depth").alias("more"))
        done = stored(below.join(above, "up").select("node", "root", (F.col("steps") + F.col("more")).alias("depth")))
        leap = below.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        before = below
        below, left = counted(below.join(leap, "up").select("node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps")))
        discard(before)
        done_so_far = done_so_far.unionByName(done)
        if left == waiting:  # only cycles don't get fewer
            break
        waiting = left
    return done_so_far


def tree_summary(tree: DataFrame) -> DataFrame:
    counts = tree.agg(F.count("*").alias("total_nodes"), F.count_distinct("categoryid").alias("unique_categories"), F.count_if(F.col("parentid").isNull()).alias("root_categories"))
    depths = root_depths(tree).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_depth"))
    return counts.join(F.broadcast(depths), F.lit(True))  # one row each


def children_counts(tree: DataFrame, top: int | None = None) -> DataFrame:
    found = tree.filter("parentid IS NOT NULL").groupBy("parentid").agg(F.count("*").alias("n"))
    return found if top is None else found.orderBy(F.desc("n"), "parentid").limit(top)


def edges(tree: DataFrame) -> DataFrame:
    """Distinct parent-to-child pairs."""
    return tree.na.drop(subset=["parentid", "categoryid"]).select(F.col("parentid").alias("src"), F.col("categoryid").alias("dst")).distinct()


def degrees(tree: DataFrame, labelled_from: int = 5) -> DataFrame:
    """node, out_degree, in_degree, degree, size (8 to 25) and whether the node shows a label."""
    ends = edges(tree).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    found = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    out = F.col("out_degree")
    return found.select("node", "out_degree", "in_degree", (out + F.col("in_degree")).alias("degree"), F.greatest(F.lit(8.0), F.least(F.lit(25.0), 8 + 0.5 * out)).alias("size"), (out >= labelled_from).alias("labelled"))


def trimmed_edges(tree: DataFrame, most: int = 200, kept: int = 150) -> DataFrame:
    """All edges of a graph of up to `most` nodes; of a larger one, those among the `kept` nodes of most degree and their neighbours.

    Ties of degree go to the smaller id.
    """
    links, ranked = edges(tree), degrees(tree)
    size = ranked.agg(F.count("*").alias("n_nodes"))
    core = ranked.orderBy(F.desc("degree"), "node").limit(kept).select("node")
    near = links.join(core, links.src == core.node).select(F.col("dst").alias("node")).union(links.join(core, links.dst == core.node).select(F.col("src").alias("node")))
    nodes = core.union(near).distinct()
    induced = links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", F.lit(True).alias("trimmed"))
    return links.select("src", "dst", F.lit(False).alias("trimmed")).union(induced).join(F.broadcast(size), F.lit(True)).filter((F.col("n_nodes") > most) == F.col("trimmed")).select("src", "dst")


def layout(tree: DataFrame, most: int = 200, kept: int = 150) -> DataFrame:
    """A figure of the (trimmed) graph: node, x and y, size and whether it shows a label.

    y is the least depth below a root of the figure, x the place in its row, in the order of roots and nodes. Made for the few thousand nodes that a figure can show.
    """
    return layout_of(stored(trimmed_edges(tree, most, kept)))


def layout_of(links: DataFrame) -> DataFrame:
    """`layout` of given edges (src, dst), which are read several times."""
    tops = links.select("src").distinct().join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    placed = reached(tops.select(F.col("src").alias("node")), links.select("src", "dst"))
    row = Window.partitionBy("level").orderBy("root", "node")
    ends = links.select(F.col("dst").alias("categoryid"), F.col("src").alias("parentid"))
    return placed.select("node", F.row_number().over(row).alias("x"), F.col("level").alias("y")).join(degrees(ends).select("node", "size", "labelled"), "node")
