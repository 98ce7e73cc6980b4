"""What a merge writes: relations, one JSON report, SARIF results, text lines, settings, scopes, the verdict.

Large relations are written as relations. Only ``report`` gathers rows into one
document, because one document is its meaning; put the cap on findings first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.merge import CANONICAL

CLEAN, FAILED, REFUSED, NO_ANSWER, PENDING = range(5)  # fixed values: exit codes
SARIF_LEVELS = {"deny": "error", "warn": "warning", "allow": "note"}


def write_once(rows: DataFrame, path: str, layout: str = "parquet") -> None:
    """Whole or nothing: an existing path is refused, and readers see no part of a failed write."""
    rows.write.mode("errorifexists").format(layout).save(path)


def finding_lines(findings: DataFrame) -> DataFrame:
    """Findings as text: path, then ``path:line:column: severity code message``."""
    return findings.select(*CANONICAL, F.format_string("%s:%d:%d: %s %s %s", "path", "line", "col", "severity", "code", "message").alias("value"))


def annotation_lines(findings: DataFrame) -> DataFrame:
    """Findings as workflow annotations; %, CR and LF are escaped."""
    text = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    level = F.when(F.col("severity") == "deny", "error").otherwise("warning")
    return findings.select(*CANONICAL, F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", level, "path", "line", "col", "code", text).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per component: its first finding, with every other as a related location."""
    place = lambda f: F.struct(F.struct(F.struct(f.path.alias("uri")).alias("artifactLocation"), F.struct(f.line.alias("startLine"), f.col.alias("startColumn")).alias("region")).alias("physicalLocation"))
    members = F.array_sort(F.collect_list(F.struct(*CANONICAL, "severity", "message")))
    grouped = findings.groupBy("component").agg(members.alias("m"))
    first = F.col("m")[0]
    level = F.coalesce(F.create_map(*(F.lit(x) for kv in SARIF_LEVELS.items() for x in kv))[first.severity], F.lit("warning"))
    related = F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), place)
    result = F.struct(first.code.alias("ruleId"), level.alias("level"), F.struct(first.message.alias("text")).alias("message"), F.array(place(first)).alias("locations"), related.alias("relatedLocations"))
    return grouped.select("component", F.to_json(result).alias("result"))


def report(findings: DataFrame, evaluations: DataFrame, totals: DataFrame) -> DataFrame:
    """One row, ``report``: the merged report as JSON, its arrays in canonical order. totals has one row."""
    held = findings.agg(F.array_sort(F.collect_list(F.struct(*CANONICAL, *(c for c in findings.columns if c not in CANONICAL)))).alias("findings"))
    sides = evaluations.agg(F.array_sort(F.collect_list(F.struct("edge", "side", "symbol", "state", "analyzer"))).alias("edge_evaluations"))
    summed = totals.select(F.struct(*totals.columns).alias("totals"))
    return held.crossJoin(sides).crossJoin(summed).select(F.to_json(F.struct("findings", "edge_evaluations", "totals")).alias("report"))  # three single rows


def settings_document(resolved: DataFrame) -> DataFrame:
    """One row, ``document``: key, value (JSON text) and source of every setting, keys ascending, then provenance."""
    pairs = resolved.agg(F.array_sort(F.collect_list(F.struct("key", "value", "source"))).alias("s"))
    member = lambda v: F.transform("s", lambda e: F.concat(F.to_json(F.array(e.key)).substr(F.lit(2), F.length(F.to_json(F.array(e.key))) - 2), F.lit(":"), v(e)))
    quoted = lambda e: F.concat(F.lit('"'), e.source, F.lit('"'))
    body = F.concat_ws(",", F.array_join(F.filter(member(lambda e: e.value), lambda x: x.isNotNull()), ","))
    return pairs.select(F.concat(F.lit("{"), body, F.lit(',"provenance":{'), F.array_join(member(quoted), ","), F.lit("}}")).alias("document"))


def scope_document(modules: DataFrame) -> DataFrame:
    """One row per document: the scope (document, place, role, id, path) as JSON with absolute paths."""
    each = F.struct("place", F.struct("id", "role", "path").alias("module"))
    grouped = modules.where("role <> 'workspace'").groupBy("document").agg(F.array_sort(F.collect_list(each)).alias("m"))
    consumers = F.transform(F.filter("m", lambda x: x.module.role == "consumer"), lambda x: x.module)
    target = F.filter("m", lambda x: x.module.role == "target")[0].module
    space = modules.where("role = 'workspace'").select("document", F.col("path").alias("workspace"))
    return grouped.join(space, "document", "left").select("document", F.to_json(F.struct(target.alias("target"), consumers.alias("consumers"), "workspace")).alias("scope"))


def language_census(counts: DataFrame, analyzers: DataFrame) -> DataFrame:
    """kind, name, language: languages found, and what each analyzer (name, languages) claims of them."""
    found = counts.select(F.lit("language").alias("kind"), F.lit("tree").alias("name"), "language")
    claims = analyzers.select("name", F.explode("languages").alias("language")).join(counts.select("language"), "language", "left_semi")
    return found.union(claims.select(F.lit("analyzer").alias("kind"), "name", "language"))


def verdict(failing: Column, stale: Column, refused: Column, answered: Column) -> Column:
    """The exit code: refused, no answer, failed on a finding or a stale suppression, clean."""
    return F.when(refused, REFUSED).when(~answered, NO_ANSWER).when((failing > 0) | (stale > 0), FAILED).otherwise(CLEAN)
