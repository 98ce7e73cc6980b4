"""Union, pair resolution, promotion and components of analyzer reports.

Canonical order of findings: path, line, column, code, ref, analyzer, bytewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.plans.graph import connected, reachable

CANONICAL = ("path", "line", "col", "code", "ref", "analyzer")
STATES = ("live", "dead", "absent")  # strongest first


def state_rank(state: str = "state") -> Column:
    return F.when(F.col(state) == "live", 0).when(F.col(state) == "dead", 1).otherwise(2)


def stamp(report: DataFrame, analyzer: str) -> DataFrame:
    return report.withColumn("analyzer", F.lit(analyzer))


def union_reports(reports: list[DataFrame]) -> DataFrame:
    """Multiset union: what two analyzers report twice stays twice."""
    first, *rest = reports
    for r in rest:
        first = first.unionByName(r, allowMissingColumns=True)
    return first


def canonical_rank(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each finding in canonical order, within ``by``."""
    window = Window.partitionBy(*by).orderBy(*CANONICAL)
    return findings.withColumn("place", F.row_number().over(window))


def first_per(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: one pre-summed aggregate, no sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def strongest_states(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("edge", "side").agg(F.min(state_rank()).alias("state_rank"))


def unresolved(evaluations: DataFrame) -> DataFrame:
    """Dead evaluations whose edge has no other side: a merge refuses these."""
    sides = evaluations.groupBy("edge").agg(F.count_distinct("side").alias("sides"))
    return evaluations.where("state = 'dead'").join(sides.where("sides = 1"), "edge", "left_semi")


def _others(evaluations: DataFrame) -> DataFrame:
    """edge, side, and of the edge's other sides: whether one is live, whether one is dead."""
    sides = evaluations.groupBy("edge", "side").agg(F.max((F.col("state") == "live").cast("int")).alias("live"), F.max((F.col("state") == "dead").cast("int")).alias("dead"))
    other = sides.select(F.col("edge").alias("e"), F.col("side").alias("s"), "live", "dead")
    pairs = sides.select("edge", "side").join(other, (F.col("edge") == F.col("e")) & (F.col("side") != F.col("s")))
    return pairs.groupBy("edge", "side").agg(F.max("live").alias("other_live"), F.max("dead").alias("other_dead"))


def pair_graph(evaluations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (node) and arcs (src, dst) of the pair rule; nodes other than components begin with a NUL.

    A dead evaluation's component is a seed if another side of its edge is live, or none
    is dead. If a component falls, so do those whose dead evaluations lean on it. Arcs go
    through one node for each edge and side, which stands for "another side of this edge
    reads live", so they stay linear in the evaluations and two of them are one edge.
    """
    dead = evaluations.where("state = 'dead'")
    judged = dead.join(_others(evaluations), ["edge", "side"])
    seeds = judged.where("other_live = 1 or other_dead = 0").select(F.col("component").alias("node"))
    side = lambda s: F.concat(F.lit("\0"), F.col("edge"), F.lit("\0"), F.col(s))
    sides = dead.select("edge", "side").distinct()
    across = sides.join(sides.select("edge", F.col("side").alias("other")), "edge").where("side <> other")
    up = dead.join(across, ["edge", "side"]).select(F.col("component").alias("src"), side("other").alias("dst"))
    down = dead.select(side("side").alias("src"), F.col("component").alias("dst"))
    return seeds, up.unionByName(down)


def dropped_components(evaluations: DataFrame) -> DataFrame:
    """Components dropped by the pair rule, as reachability."""
    found = reachable(*pair_graph(evaluations))
    return found.where(~F.col("node").startswith("\0")).select(F.col("node").alias("component"))


def promoted(evaluations: DataFrame) -> DataFrame:
    """Dead evaluations that survive, with all their columns: the pending findings that are reported."""
    answered = evaluations.where("state = 'dead'").join(_others(evaluations), ["edge", "side"], "left_semi")
    return answered.join(dropped_components(evaluations), "component", "left_anti")


def promotions(kept: DataFrame) -> DataFrame:
    """One row per promoted finding: its canonical key and component, with every edge side that carried it (carriers, sorted)."""
    key = [c for c in CANONICAL if c in kept.columns]
    carriers = F.array_sort(F.collect_set(F.struct("edge", "side"))).alias("carriers")
    return kept.groupBy(*key, "component").agg(carriers)


def surviving(evaluations: DataFrame) -> DataFrame:
    """The evaluations that a merged report keeps: live and absent ones."""
    return evaluations.where("state <> 'dead'")


def component_labels(kept: DataFrame, joins: DataFrame | None = None) -> DataFrame:
    """component, label: components that promotions of one edge's sides join, and binding joins (component, other), by
    the one whose promoted finding comes first in canonical order.

    Links go through the edge, so an edge with many promotions gives no pairs.
    """
    sides = kept.groupBy("edge").agg(F.count_distinct("side").alias("n"))
    joined = kept.join(sides.where("n > 1"), "edge", "left_semi")
    hubs = joined.groupBy("edge").agg(F.min("component").alias("a"))
    links = joined.join(hubs, "edge").select("a", F.col("component").alias("b"))
    if joins is not None:
        links = links.union(joins.select("component", "other"))
    labels = connected(links.distinct())
    first = kept.groupBy("component").agg(F.min(F.struct(*CANONICAL)).alias("place"))
    every = first.select("component") if joins is None else first.select("component").union(joins.select("component")).union(joins.select("other")).distinct()
    sets = every.join(labels, F.col("component") == F.col("node"), "left").select("component", F.coalesce("label", "component").alias("connected_set"))
    placed = sets.join(first, "component", "left")
    # a component without a promoted finding of its own is only reached after one that has
    named = placed.groupBy("connected_set").agg(F.min(F.struct(F.col("place").isNull().alias("late"), "place", "component")).alias("first"))
    return sets.join(named, "connected_set").select("component", F.col("first.component").alias("label"))


def joined_sums(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """component, label, symbols, deletable: counts summed over the joined set, each component's own as its first finding carries them."""
    own = first_per(kept.select("component", "symbols", "deletable", *CANONICAL), ["component"], list(CANONICAL)).select("component", "symbols", "deletable")
    set_of = labels.join(own, "component", "left").groupBy("label").agg(F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("deletable"), F.lit(0)).alias("deletable"))
    return labels.join(set_of, "label").select("component", "label", "symbols", "deletable")


def component_members(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """label, members: the distinct refs of all findings of a joined set, ascending; written as one row a set, as a listing has it."""
    return findings.join(labels, "component").groupBy("label").agg(F.array_sort(F.collect_set("ref")).alias("members"))


def stale_edges(evaluations: DataFrame) -> DataFrame:
    """Edges with a wholly absent side, numbered bytewise; the first such side, provides before used_by."""
    absent = strongest_states(evaluations).where("state_rank = 2").groupBy("edge").agg(F.min("side").alias("side"))
    return absent.withColumn("number", F.row_number().over(Window.orderBy("edge")))  # as many rows as stale edges


def capped(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings with the class of their joined set's roots that aren't test-only, if that is lower (a larger rank); others as they are."""
    known = findings.join(labels, "component", "left")
    caps = known.where("root = 1 and test_only = 0 and label is not null").groupBy("label").agg(F.max("class_rank").alias("cap"))
    return known.join(caps, "label", "left").withColumn("class_rank", F.greatest("class_rank", F.coalesce("cap", F.lit(0)))).drop("cap")
