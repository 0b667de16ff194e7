"""Links between the members of cells, without all pairs of a cell.

Every member of a cell is compared with the cell's centre: the member that the
most others meet in their cells, so that of an original and its edited copies
it is the original. What is linked by then is one component. What is left are
pairs of a cell that lie in different components, neither of them the centre;
of those, one at least is outside the cell's main component. `rest` compares
all of these, so no link between components is lost, whatever a cell's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unplaced
from .components import components

Step = Callable[[DataFrame], DataFrame]


def shared_cells(members: DataFrame) -> DataFrame:
    """The members (cell, node) of cells that hold more than one: cell, node, size.

    By a merge join at every size: members are mostly exploded from a smaller table, and
    Spark takes them for no larger than that, so it would broadcast them by way of the driver."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    return materialize(members.join(sizes.withColumn("cell", unplaced(F.col("cell"))).hint("merge"), "cell"), "cells")


def connect(shared: DataFrame, star: Step, rest: Step) -> DataFrame:
    """Links (a, b) that connect all nodes that links within cells connect.

    shared: cell, node, size. star gets distinct pairs (a, b) and gives those that
    are linked. rest gets cell, node, label, stray (whether it is outside the
    cell's main component) and gives the links of strays with members of other
    labels, one for each stray and label at least.
    """
    met = shared.groupBy("node").agg(F.sum("size").alias("met")).withColumn("node", unplaced(F.col("node")))
    best = shared.join(met, "node").groupBy("cell").agg(F.max(F.struct("met", "node")).alias("best"))
    best = best.select(unplaced(F.col("cell")).alias("cell"), F.col("best.node").alias("centre"))
    others = materialize(shared.select("cell", "node").join(best, "cell").where("node <> centre"), "others")
    stars = star(others.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    found = components(stars).select(unplaced(F.col("node")).alias("node"), F.col("root").alias("label"))
    labelled = others.select("cell", "node").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sums = labelled.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell")
    mixed = sums.agg(F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.select(unplaced(F.col("cell")).alias("cell"), F.col("main.label").alias("main"))
    open_ = materialize(labelled.join(mixed, "cell").select("cell", "node", "label", (F.col("label") != F.col("main")).alias("stray")), "open")
    return stars.union(rest(open_))
