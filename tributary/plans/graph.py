"""Reachability and connected sets as rounds of joins over written tables."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.tables import Tables

FOLD_ROUNDS = 24  # rounds after which what is known becomes one table and arcs get shortcuts, which cost about as much
DOUBLINGS = 3  # of the steps that an arc may stand for, each time
MOST_ARCS = 64  # arcs that a node may have for and with its shortcuts


def reachable(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """node: everything reachable from ``seeds`` (node) along ``arcs`` (src, dst), however long the way."""
    return reduce(DataFrame.union, _rounds(seeds.select("node", F.lit(0).alias("grade")), arcs)).select("node")  # of one grade nodes come once


def reachable_by_grade(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """node, grade: everything reachable, with the smallest grade of the ``seeds`` (node, grade) that lead to it."""
    return _least(reduce(DataFrame.union, _rounds(seeds, arcs)))


def _rounds(seeds: DataFrame, arcs: DataFrame) -> list[DataFrame]:
    """Tables of node, grade: what is reachable, a node again where a later round finds a smaller grade.

    Semi-naive: each round takes two steps from what was new in the last one only, and
    writes only what is new again. Where many rounds are needed, nodes not reached
    yet get arcs to all that two of their arcs reach, as long as those are few; so
    long chains take rounds by the logarithm of their length.
    """
    tables = Tables(seeds.sparkSession, "reachable")
    arcs = tables.save(arcs.select("src", "dst").where("src <> dst").distinct())
    first = frontier = tables.save(_least(seeds))
    known = [frontier]
    for k in count(1):  # ends: every round adds nodes or makes grades smaller
        once = _step(frontier, arcs)
        twice = _step(once, arcs)
        found = tables.save(_least(once.union(twice)))
        before = reduce(DataFrame.union, known).select(F.col("node").alias("at"), F.col("grade").alias("best"))
        met = found.join(before, (F.col("node") == F.col("at")) & (F.col("best") <= F.col("grade"))).select("at")  # inner: a small side of either is broadcast
        frontier = tables.save(found.join(met, F.col("node") == F.col("at"), "left_anti"))
        if frontier.isEmpty():
            return known
        known.append(frontier)
        if k % FOLD_ROUNDS == 0:
            behind = tables.save(_least(reduce(DataFrame.union, known[:-1])))
            final = behind.join(F.broadcast(first.agg(F.min("grade").alias("grade"))), "grade").select("node")  # they and what they lead to stay as they are
            for end in ("src", "dst"):
                arcs = arcs.join(final, F.col(end) == F.col("node"), "left_anti")
            for _ in range(DOUBLINGS):
                arcs = tables.save(_with_shortcuts(arcs))
            known = [behind, frontier]


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("grade").alias("grade"))


def _step(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    return _least(nodes.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "grade"))


def _with_shortcuts(arcs: DataFrame) -> DataFrame:
    """The arcs, and those that two of them make from nodes that have MOST_ARCS at most with them."""
    degrees = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    ahead = arcs.join(degrees, F.col("dst") == F.col("node")).select("src", "dst", "n")
    few = ahead.groupBy("src").agg((F.sum("n") + F.count("*")).alias("n")).where(F.col("n") <= MOST_ARCS).select("src")
    second = arcs.select(F.col("src").alias("middle"), F.col("dst").alias("end"))
    two = arcs.join(few, "src", "left_semi").join(second, F.col("dst") == F.col("middle")).select("src", F.col("end").alias("dst"))
    return arcs.union(two.where("src <> dst")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) lead to. Labels double their reach each round."""
    tables = Tables(links.sparkSession, "connected")
    both = links.select("a", "b").where("a <> b")
    both = tables.save(both.union(both.select("b", "a")).distinct())
    labels = tables.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:  # ends: labels only become smaller
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("at")).select("node", "label", F.least("label", "near").alias("step"))
        ahead = labels.select(F.col("node").alias("to"), F.col("label").alias("jump"))
        moved = tables.save(step.join(ahead, F.col("step") == F.col("to"), "left").select("node", F.least("step", "jump").alias("next"), "label"))
        labels = moved.select("node", F.col("next").alias("label"))
        if moved.where("next < label").isEmpty():
            return labels
