"""Golden cases of the merge."""

import itertools
import random

import pytest

from tributary.operators import accounting, merge, paths
from tributary.plans.graph import connected, reachable

EVAL = "analyzer string, edge string, side string, symbol string, state string, component string, path string, line int, col int, code string, ref string, symbols int, deletable int, class_rank int, root int, test_only int"


def evaluations(spark, rows):
    return spark.createDataFrame([("a", e, s, f"{e}/{s}/{i}", st, c, "f", i, 1, "X1", f"r{i}", 1 + i % 3, 5, i % 3, 1, 0) for i, (e, s, st, c) in enumerate(rows)], EVAL)


def kept(spark, rows):
    return sorted(r.component for r in merge.promoted(evaluations(spark, rows)).collect())


def test_dead_beside_live_is_not_promoted(spark):
    assert kept(spark, [("e", "provides", "dead", "p"), ("e", "used_by", "live", "u")]) == []


def test_dead_pair_is_promoted_and_joined(spark):
    rows = [("e", "provides", "dead", "p"), ("e", "used_by", "dead", "u")]
    assert kept(spark, rows) == ["p", "u"]
    labels = merge.component_labels(merge.promoted(evaluations(spark, rows))).collect()  # p comes first in canonical order
    assert {r.component: r.label for r in labels} == {"p": "p", "u": "p"}


def test_dead_against_absent_only_is_stale(spark):
    rows = [("e", "provides", "dead", "p"), ("e", "used_by", "absent", "u")]
    assert kept(spark, rows) == []
    assert [(r.edge, r.side, r.number) for r in merge.stale_edges(evaluations(spark, rows)).collect()] == [("e", "used_by", 1)]


def test_dead_without_other_side_is_refused(spark):
    assert merge.unresolved(evaluations(spark, [("e", "provides", "dead", "p")])).count() == 1


def test_absent_beside_dead_is_promoted(spark):
    assert kept(spark, [("e", "provides", "dead", "p"), ("e", "used_by", "dead", "u"), ("e", "used_by", "absent", "v")]) == ["p", "u"]


def brute_dropped(rows):
    dead = [(e, s, c) for e, s, st, c in rows if st == "dead"]
    dropped = set()
    while True:
        more = set()
        for e, s, c in dead:
            others = ["live" if st == "dead" and oc in dropped else st for oe, os_, st, oc in rows if oe == e and os_ != s]
            if others and ("live" in others or "dead" not in others):
                more.add(c)
        if more <= dropped:
            return dropped
        dropped |= more


@pytest.mark.parametrize("seed", range(3))
def test_fixpoint_against_literal_rules(spark, seed):
    r = random.Random(seed)
    rows = [(f"e{r.randrange(12)}", r.choice(["provides", "used_by"]), r.choice(["dead"] * 7 + ["live", "absent"]), f"c{r.randrange(14)}") for _ in range(40)]
    found = {x.component for x in merge.dropped_components(evaluations(spark, rows)).collect()}
    assert found == brute_dropped(rows)


def test_graphs(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert sorted(r.node for r in reachable(spark.createDataFrame([(1,)], "node long"), arcs).collect()) == [1, 2, 3]
    chain = spark.createDataFrame([(i, i + 1) for i in itertools.chain(range(20), range(30, 40))], "a long, b long")
    labels = {r.node: r.label for r in connected(chain).collect()}
    assert set(labels.values()) == {0, 30} and labels[20] == 0 and labels[40] == 30


def test_distinct_lines(spark):
    spans = spark.createDataFrame([("c", "f", 1, 5), ("c", "f", 3, 8), ("c", "f", 10, 10), ("c", "g", 1, 2)], "component string, path string, line int, end_line int")
    assert accounting.distinct_lines(spans, ["component"]).first().lines == 11


def test_globs():
    import re

    assert re.search(paths.glob_regex("a*.p?"), "a/b.py") and not re.search(paths.glob_regex("a.p"), "aXp")


def test_set_is_named_by_its_first_finding_and_summed(spark):
    rows = [("e", "provides", "dead", "z"), ("e", "used_by", "dead", "a"), ("f", "provides", "dead", "a"), ("f", "used_by", "dead", "m"), ("g", "provides", "dead", "b"), ("g", "used_by", "dead", "c")]
    pending = merge.promoted(evaluations(spark, rows))
    labels = merge.component_labels(pending)
    assert {r.component: r.label for r in labels.collect()} == {"z": "z", "a": "z", "m": "z", "b": "b", "c": "b"}
    assert {(r.label, r.symbols, r.deletable) for r in merge.joined_sums(pending, labels).collect()} == {("z", 1 + 2 + 1, 15), ("b", 2 + 3, 10)}
    assert {r.ref: r.class_rank for r in merge.capped(pending, labels).collect()} == {"r0": 2, "r1": 2, "r2": 2, "r3": 2, "r4": 2, "r5": 2}
    bound = merge.component_labels(pending, spark.createDataFrame([("c", "m"), ("c", "q")], "component string, other string"))
    assert {r.component: r.label for r in bound.collect()} == {x: "z" for x in "zambcq"}


def test_long_chains(spark):
    """500 edges of which each leans on the one before: no limit of rounds."""
    rows = [("e0", "provides", "live", "l")] + [x for i in range(500) for x in ((f"e{i}", "used_by", "dead", f"c{i}"), (f"e{i + 1}", "provides", "dead", f"c{i}"))] + [("e500", "used_by", "dead", "c500"), ("x", "provides", "dead", "o1"), ("x", "used_by", "dead", "o2")]
    found = {r.component for r in merge.dropped_components(evaluations(spark, rows)).collect()}
    assert found == {f"c{i}" for i in range(501)}


def test_reachable_against_brute_force(spark):
    r = random.Random(11)
    arcs = [(r.randrange(300), r.randrange(300)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 1000)]
    seen, todo = set(), [5, 7]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [b for a, b in arcs if a == n]
    got = reachable(spark.createDataFrame([(5,), (7,)], "node long"), spark.createDataFrame(arcs, "src long, dst long"))
    assert {x.node for x in got.collect()} == seen and got.count() == len(seen)
    assert reachable(spark.createDataFrame([], "node long"), spark.createDataFrame(arcs, "src long, dst long")).count() == 0


def test_only_findings_without_analyzer_are_restated(spark):
    levels = spark.createDataFrame([("X1", 0), ("X2", 2)], "code string, level int")
    found = spark.createDataFrame([("", "X1", 1), ("a", "X1", 1), ("", "X2", 1), ("a", "X2", 1), ("", "X3", 0)], "analyzer string, code string, severity_rank int")
    assert sorted(tuple(r) for r in accounting.restate(found, levels).collect()) == [("", "X2", 2), ("", "X3", 0), ("a", "X1", 1), ("a", "X2", 1)]


def test_shared_findings_are_counted_once(spark):
    """A finding of two components counts one symbol and its lines too often; one of a single component nothing."""
    rows = [("r1", "f", 1, 5, "a"), ("r1", "f", 1, 5, "b"), ("r2", "f", 4, 8, "a"), ("r2", "f", 4, 8, "b"), ("r3", "f", 100, 200, "a"), ("r4", "g", 1, 1, "c"), ("r4", "g", 1, 1, "d"), ("r4", "g", 1, 1, "e"), ("r4", "g", 1, 1, "e")]
    carriers = spark.createDataFrame(rows, "ref string, path string, line int, end_line int, component string")
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")], "component string, label string")
    assert sorted(tuple(r) for r in accounting.shared_line_correction(carriers, labels).collect()) == [("a", 2, 8), ("c", 2, 2)]
