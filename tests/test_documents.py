"""Readers and writers on hand-made documents."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tributary.sinks import outputs
from tributary.sources import documents as docs


def finding(line, component="a/c-1", message="unused"):
    return {
        "code": "X1", "position": {"path": "p/a.go", "line": line, "column": 1, "end_line": line}, "symbol": {"ref": f"go://p#S{line}"}, "severity": "deny",
        "component": {"id": component, "root": True, "deletable_lines": 3}, "message": message, "test_only": False, "confidence": "certain",
    }


@pytest.fixture
def read(spark, tmp_path):
    report = {
        "analyzer": {"name": "a", "languages": ["go"]}, "findings": [finding(2), finding(1, message="50%\nunused")],
        "edge_evaluations": [{"edge": "e", "side": "provides", "symbol": "go://p#E", "state": "dead", "finding": finding(9, "a/c-2")}, {"edge": "e", "side": "used_by", "symbol": "x", "state": "live"}],
    }
    (tmp_path / "report.json").write_text(json.dumps(report, indent=1))
    return docs.reports(docs.documents(spark, str(tmp_path)))


def test_report_relations(read):
    assert sorted((r.analyzer, r.line, r.component) for r in docs.findings(read).collect()) == [("a", 1, "a/c-1"), ("a", 2, "a/c-1")]
    assert sorted((r.side, r.state, r.component) for r in docs.evaluations(read).collect()) == [("provides", "dead", "a/c-2"), ("used_by", "live", None)]


def test_absent_and_refused(spark, tmp_path):
    assert docs.documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "good.json").write_text("{}")
    assert [(r.path.rsplit("/")[-1], r.reason) for r in docs.refusals(docs.documents(spark, str(tmp_path))).collect()] == [("bad.json", "not JSON")]


def test_repeated_keys_and_trailing_text(spark):
    cases = {
        '{"a": 1, "a": 2}': "repeated key", '{"a": {"b": 1, "b": 2}}': "repeated key", '{"s": [{"k": 1, "o": 2, "k": 3}]}': "repeated key", '{"a": 1, "\\u0061": 2}': "repeated key",
        '{"a": 1} x': "not JSON", "1}, {": "not JSON", "1], [2": "not JSON", '1, "x": 2': "not JSON", '{"a": [1, 2}': "not JSON", '{"a": 1,}': "not JSON", "": "not JSON",
        '{"a": 1, "A": 2}': None, '{"a": {"a": {"a": 1}}}': None, '[{"a": 1}, {"a": 2}]': None, ' {"a": "}, {"}\n': None, "{}": None,
    }
    rows = spark.createDataFrame([(c, len(c), c) for c in cases], docs.DOCUMENT)
    assert {r.path: r.reason for r in docs.refusals(rows).collect()} == {c: reason for c, reason in cases.items() if reason}


def test_edges_and_settings(spark):
    text = json.dumps({"edges": {"e2": {"provides": "proto://a#B", "used_by": "go://x"}, "e1": {"used_by": "proto://c"}}})
    found = docs.edges(spark.createDataFrame([(text,)], "content string"), "proto").collect()
    assert sorted(map(tuple, found)) == [("e1", "used_by", "proto://c"), ("e2", "provides", "proto://a#B")]
    stated = docs.settings(spark.createDataFrame([('{"a": {"b": 1}, "c": "x"}',)], "content string"), ["a.b", "c", "d"], 1, "repository").collect()
    assert sorted((r.key, r.value, r.source) for r in stated) == [("a.b", "1", "repository"), ("c", "x", "repository")]


def test_scope_round_trip(spark):
    text = json.dumps({"target": {"path": "lib"}, "consumers": [{"id": "w", "path": "../web"}, {"path": "/abs/./app"}], "workspace": "go.work"})
    rows = docs.scope(spark.createDataFrame([("file:/r/s/scope.json", 1, text)], docs.DOCUMENT))
    assert [(r.role, r.id, r.path) for r in rows.orderBy("place").collect()] == [
        ("target", None, "/r/s/lib"), ("consumer", "w", "/r/web"), ("consumer", None, "/abs/app"), ("workspace", None, "/r/s/go.work")]
    written = json.loads(outputs.scope_document(rows).collect()[0].scope)
    assert written["workspace"] == "/r/s/go.work" and [c["path"] for c in written["consumers"]] == ["/r/web", "/abs/app"]


@pytest.mark.parametrize(
    ("text", "module"),
    [("// c\nmodule  a.b/c // d\ngo 1.2", "a.b/c"), ("module (\n\n\t\"x/y\"\n)", "x/y"), ("module `q`", "q"), ("modules a", None), ("go 1.2", None), ("module a b", None), ("", None), (None, None)],
)
def test_go_module(spark, text, module):
    assert spark.createDataFrame([(text,)], "content string").select(docs.go_module(F.col("content"))).collect()[0][0] == module


@pytest.mark.parametrize(("text", "name"), [('{"name": "a"}', "a"), ('{"Name": "a"}', None), ('{"name": 3}', None), ('{"name": ""}', None), ("[]", None), ("{", None)])
def test_package_name(spark, text, name):
    assert spark.createDataFrame([(text,)], "content string").select(docs.package_name(F.col("content"))).collect()[0][0] == name


def test_governing_module(spark):
    folders = spark.createDataFrame([("a/b/c",), ("a",), ("x",)], "dir string")
    manifests = spark.createDataFrame([("a", "module top"), ("a/b", "module low")], "dir string, content string")
    assert dict(map(tuple, docs.governing_module(folders, manifests).collect())) == {"a/b/c": "low", "a": "top", "x": None}


def test_handshake(spark):
    shape = "name string, languages array<string>, schema_versions_accepted array<string>, facts_versions array<string>, conformance string"
    known = spark.createDataFrame([("a", ["go"], ["9"], ["1"], "pass"), ("b", ["ts"], ["8"], ["1"], "pass")], shape)
    asked = spark.createDataFrame([("a", ["go"], ["9"], None), ("a", ["go", "ts"], ["9"], None), ("b", ["ts"], ["9"], "1"), ("c", [], ["9"], None), ("b", [], ["8"], "2")], "name string, languages array<string>, schema_versions array<string>, facts_version string")
    assert sorted(map(tuple, docs.handshakes(known, asked).collect())) == [("a", "language"), ("b", "facts version"), ("b", "schema version"), ("c", "name")]


def test_renderings(spark, read, tmp_path):
    found = docs.findings(read)
    assert outputs.finding_lines(found).orderBy("line").collect()[1].value == "p/a.go:2:1: deny X1 unused"
    assert outputs.annotation_lines(found).orderBy("line").collect()[0].value == "::error file=p/a.go,line=1,col=1,title=X1::50%25%0Aunused"
    (result,) = (json.loads(r.result) for r in outputs.sarif_results(found).collect())
    assert result["level"] == "error" and len(result["relatedLocations"]) == 1
    merged = json.loads(outputs.report(found, docs.evaluations(read), spark.sql("select 2 as findings")).collect()[0].report)
    assert [f["line"] for f in merged["findings"]] == [1, 2] and merged["totals"] == {"findings": 2}
    outputs.write_once(found, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        outputs.write_once(found, str(tmp_path / "out"))


def test_settings_document_and_verdict(spark):
    resolved = spark.createDataFrame([("b", '{"x":1}', "default"), ("a", "3", "flag")], "key string, value string, source string")
    assert json.loads(outputs.settings_document(resolved).collect()[0].document) == {"a": 3, "b": {"x": 1}, "provenance": {"a": "flag", "b": "default"}}
    cases = spark.createDataFrame([(0, 0, False, True), (1, 0, False, True), (0, 1, False, True), (0, 0, True, True), (1, 0, False, False)], "f int, s int, r boolean, a boolean")
    assert [r[0] for r in cases.select(outputs.verdict(F.col("f"), F.col("s"), F.col("r"), F.col("a"))).collect()] == [0, 1, 1, 2, 3]


def test_language_census(spark):
    counts = spark.createDataFrame([("go", 3)], "language string, files long")
    tools = spark.createDataFrame([("a", ["go", "ts"])], "name string, languages array<string>")
    assert sorted(map(tuple, outputs.language_census(counts, tools).collect())) == [("analyzer", "a", "go"), ("language", "tree", "go")]
