"""JSON reports, edges, scopes and settings, and module manifests, read as relations.

Documents come whole from Spark's binary-file source, so a folder of a hundred
thousand reports is read by all executors; a missing path is an empty relation.
A document over MOST_BYTES, one that isn't JSON or one that repeats a key becomes a refusal with its reason.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.paths import ancestors

MOST_BYTES = 16 << 20  # fixed value: the size that one document may hold
DOCUMENT = "path string, length bigint, content string"
POSITION = "struct<path: string, line: int, column: int, end_line: int>"
FINDING = (
    f"struct<code: string, kind: string, language: string, position: {POSITION}, symbol: struct<ref: string, kind: string, name: string, size_lines: int>,"
    " confidence: string, test_only: boolean, generated: boolean, component: struct<id: string, root: boolean, symbol_count: int, deletable_lines: int>,"
    " severity: string, message: string>"
)
REPORT = (
    "schema_version string, contract_version string,"
    " analyzer struct<name: string, version: string, languages: array<string>, schema_versions_accepted: array<string>, conformance: struct<corpus_version: string, result: string, digest: string>>,"
    " target struct<kind: string, root: string, identity: string>, configurations array<struct<id: string, os: string, arch: string, tags: array<string>, project: string>>,"
    f" findings array<{FINDING}>, edge_evaluations array<struct<edge: string, side: string, symbol: string, state: string, finding: {FINDING}>>,"
    " totals struct<findings: int, deletable_lines: int, pending: int, omitted: int, stale_suppressions: int, suppressions_in_effect: int>"
)


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of whole files; content is null beyond the bound."""
    try:
        found = spark.read.format("binaryFile").load(list(paths))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DOCUMENT)
    within = F.when(F.col("length") <= MOST_BYTES, F.col("content")).cast("string")
    return found.select("path", "length", within.alias("content"))


def refusals(docs: DataFrame) -> DataFrame:
    """path, reason of documents that can't be read.

    A document is one value, alone inside an object and inside an array: what closes
    one of these early doesn't fit the other. A variant holds no key of an object
    twice, so a well-formed document that becomes none repeats a key, at any depth.
    """
    alone = F.expr("from_json(concat('{\"d\":', content, '}'), 'd string').d").isNotNull() & F.expr("from_json(concat('[', content, ']'), 'array<string>')").isNotNull()
    parsed = F.expr("try_parse_json(content)").isNotNull()
    reason = F.when(F.col("content").isNull(), "too large").when(~alone, "not JSON").when(~parsed, "repeated key")
    return docs.select("path", reason.alias("reason")).where("reason is not null")


def reports(docs: DataFrame) -> DataFrame:
    """One row per document, in the shape of REPORT."""
    return docs.select("path", F.from_json("content", REPORT).alias("report")).select("path", "report.*")


FACTS = (
    "analyzer struct<name: string, version: string>, language string,"
    f" bindings array<struct<role: string, state: string, schema: string, schema_file: string, symbol: string, via: array<string>, uses: array<string>, members: array<string>,"
    f" scope: string, cap: string, library: boolean, kind: string, finding: {FINDING}, carried: array<{FINDING}>>>"
)


def facts(docs: DataFrame) -> DataFrame:
    """Binding records of facts documents: one row a record, numbered in document order within its path."""
    read = docs.select("path", F.from_json("content", FACTS).alias("d")).select("path", "d.analyzer", "d.language", F.posexplode("d.bindings").alias("place", "b"))
    return read.select("path", F.col("analyzer.name").alias("analyzer"), F.col("analyzer.version").alias("version"), "language", "place", "b.*").withColumns(
        {"component": F.col("finding.component.id"), "ref": F.col("finding.symbol.ref"), "carried_refs": F.transform("carried", lambda f: f.symbol.ref), "carried_components": F.transform("carried", lambda f: f.component.id)}
    )


def missing_facts(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """name of analyzers asked for facts (name, facts_path) that left no document there."""
    return asked.join(docs.select(F.col("path").alias("facts_path")), "facts_path", "left_anti").select("name")


TRUSTED_EXITS = (0, 1, 4)  # fixed values: exit codes beside which a report is read


def untrusted(runs: DataFrame) -> DataFrame:
    """name, reason of runs (name, exit, reported: the report's name, merged_from) whose report isn't read: for its exit code, another
    analyzer's name or for being a merged one; the first reason."""
    reason = (
        F.when(~F.col("exit").isin(*TRUSTED_EXITS), "exit code")
        .when(F.col("reported").isNull(), "no report")
        .when(F.col("reported") != F.col("name"), "name")
        .when(F.col("merged_from").isNotNull(), "merged")
    )
    return runs.select("name", reason.alias("reason")).where("reason is not null")


def _flat_finding(f: str) -> list[Column]:
    names = {
        "position.path": "path", "position.line": "line", "position.end_line": "end_line", "position.column": "col", "code": "code", "symbol.ref": "ref",
        "component.id": "component", "component.root": "root", "component.deletable_lines": "deletable", "severity": "severity", "confidence": "confidence",
        "test_only": "test_only", "message": "message",
    }
    return [F.col(f"{f}.{source}").alias(name) for source, name in names.items()]


def findings(read: DataFrame) -> DataFrame:
    """Findings of all reports, stamped with their analyzer."""
    return read.select(F.col("analyzer.name").alias("analyzer"), F.explode("findings").alias("f")).select("analyzer", *_flat_finding("f"))


def evaluations(read: DataFrame) -> DataFrame:
    """Edge evaluations of all reports; component is null unless dead."""
    each = read.select(F.col("analyzer.name").alias("analyzer"), F.explode("edge_evaluations").alias("e"))
    return each.select("analyzer", "e.edge", "e.side", "e.symbol", "e.state", F.col("e.finding.component.id").alias("component"))


def handshakes(described: DataFrame, asked: DataFrame) -> DataFrame:
    """name, reason for each request (name, languages, schema_versions, facts_version) that its analyzer's description refuses.

    described: name, languages, schema_versions_accepted, facts_versions, conformance. The first reason in the order below is given.
    """
    d = described.toDF(*(f"described_{c}" for c in described.columns))
    met = asked.join(d, F.col("name") == F.col("described_name"), "left")
    reason = (
        F.when(F.col("described_name").isNull(), "name")
        .when(F.col("facts_version").isNotNull() & ~F.array_contains("described_facts_versions", F.col("facts_version")), "facts version")
        .when(F.size(F.array_except("languages", "described_languages")) > 0, "language")
        .when(F.col("described_conformance") != "pass", "conformance")
        .when(~F.arrays_overlap("schema_versions", "described_schema_versions_accepted"), "schema version")
    )
    return met.select("name", reason.alias("reason")).where("reason is not null")


def edges(docs: DataFrame, scheme: str) -> DataFrame:
    """edge, side, symbol of an edges document's sides whose reference has the scheme."""
    sides = docs.select(F.from_json("content", "edges map<string, map<string, string>>").alias("d")).select(F.explode("d.edges").alias("edge", "sides"))
    each = sides.select("edge", F.explode("sides").alias("side", "symbol"))
    return each.where(F.col("side").isin("provides", "used_by") & F.startswith("symbol", F.lit(f"{scheme}://")))


def cleaned(path: Column) -> Column:
    """A path without empty, '.' and '..' steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(steps, start, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def scope(docs: DataFrame) -> DataFrame:
    """document, role, place, id, path of a scope document's target, consumers and workspace; relative paths start at its folder."""
    module = "struct<id: string, path: string>"
    local = F.regexp_replace("path", "^file:/*", "/")
    read = docs.select(local.alias("document"), F.from_json("content", f"target {module}, consumers array<{module}>, workspace string").alias("d"))
    one = lambda role, m: F.struct(F.lit(role).alias("role"), m.id.alias("id"), m.path.alias("path"))
    workspace = F.struct(F.lit("workspace").alias("role"), F.lit(None).cast("string").alias("id"), F.col("d.workspace").alias("path"))
    rows = F.concat(F.array(one("target", F.col("d.target"))), F.transform(F.coalesce("d.consumers", F.array().cast(f"array<{module}>")), lambda m: one("consumer", m)), F.array(workspace))
    each = read.select("document", F.posexplode(rows).alias("place", "m")).where("m.path is not null")
    folder = F.regexp_replace("document", "/[^/]*$", "")
    path = F.when(F.startswith("m.path", F.lit("/")), F.col("m.path")).otherwise(F.concat(folder, F.lit("/"), "m.path"))
    return each.select("document", "place", "m.role", "m.id", cleaned(path).alias("path"))


def settings(docs: DataFrame, keys: list[str], rank: int, source: str) -> DataFrame:
    """key, value (JSON text), source_rank, source of the dotted ``keys`` that a nested settings document states."""
    taken = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.get_json_object("content", "$." + ".".join(k.split("."))) for k in keys)))
    each = docs.select(F.explode(taken).alias("key", "value")).where("value is not null")
    return each.select("key", "value", F.lit(rank).alias("source_rank"), F.lit(source).alias("source"))


def go_module(content: Column) -> Column:
    """The module path that a go.mod declares, on the directive's line or alone on a line in parentheses; null for none or a malformed one."""
    lines = F.transform(F.split(content, "\r?\n"), lambda s: F.regexp_replace(F.regexp_replace(s, "//.*$", ""), "^\\s+|\\s+$", ""))
    text = F.array_join(F.filter(lines, lambda s: s != ""), "\n")
    token = F.regexp_extract(text, "(?:^|\n)module(?:[ \t]+|(?=\\())(?:\\(\n)?([^\n]+)", 1)
    bare = F.regexp_replace(token, "^(?:\"(.*)\"|`(.*)`)$", "$1$2")
    return F.when(F.rlike(bare, F.lit("^[^ \t()\"`]+$")), bare)


def package_name(content: Column) -> Column:
    """A package.json's own name: a JSON string that isn't empty; null otherwise."""
    name = F.from_json(content, "map<string, string>")["name"]
    written = F.schema_of_variant(F.try_variant_get(F.try_parse_json(content), "$.name", "variant")) == "STRING"
    return F.when(written & (name != ""), name)


def governing_module(folders: DataFrame, manifests: DataFrame) -> DataFrame:
    """dir and the module of the nearest go.mod (dir, content) at or above it."""
    named = manifests.select(F.col("dir").alias("above"), go_module(F.col("content")).alias("module"))
    climbed = folders.select("dir", F.posexplode(ancestors("dir")).alias("depth", "above"))
    best = climbed.join(named, "above").groupBy("dir").agg(F.max_by("module", "depth").alias("module"))
    return folders.select("dir").distinct().join(best, "dir", "left")
