"""Reachability by grade, and the counts of what levels hold back, over one graph for all levels."""

import random

import duckdb
from pyspark.sql import functions as F

from tributary import catalog
from tributary.operators import bindings
from tributary.plans import graph
from tributary.relations import derive


def test_reachable_by_grade_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOLD_ROUNDS", 3)
    r = random.Random(5)
    arcs = [(r.randrange(200), r.randrange(200)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 1000), (3, 1020), (1030, 7)]
    seeds = [(5, 2), (3, 1), (1040, 0), (7, 3), (7, 2), (9, 3)]
    want = {}
    for node, grade in sorted(seeds, key=lambda s: s[1]):
        todo = [node]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = grade
                todo += [b for a, b in arcs if a == n]
    got = graph.reachable_by_grade(spark.createDataFrame(seeds, "node long, grade int"), spark.createDataFrame(arcs, "src long, dst long")).collect()
    assert {x.node: x.grade for x in got} == want and len(got) == len(want)


def test_levels_share_one_graph(spark, monkeypatch):
    lists = {name: F.split(f"{name}_list", ",") for name in ("via", "uses", "members")}
    records = derive(spark, "/root/testdata/sf0.001", "records").withColumns(lists).drop("via_list", "uses_list", "members_list")
    counted, save = [], graph.Tables.save

    def counting(self, rows):
        saved = save(self, rows)
        if saved.columns == ["src", "dst"]:
            counted.append(saved.count())
        return saved

    monkeypatch.setattr(graph.Tables, "save", counting)
    found = {r.level: r.n for r in bindings.withheld_counts(records, [1, 0, 1]).collect()}
    assert counted[0] == bindings.binding_graph(records)[1].where("src <> dst").distinct().count()
    duck = duckdb.connect()
    duck.execute("create view orders as select * from '/root/testdata/sf0.001/orders.parquet'")
    assert found == {level: n for level, n in duck.execute(catalog.ORACLE_SQL["withheld_counts"]).fetchall()}
