"""Rules over the declarations of schema files: what is built, held back, and how sure a finding is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.paths import ancestors, glob_regex, suffixes
from tributary.plans.graph import reachable

CERTAIN, PROBABLE, POSSIBLE = 0, 1, 2


def above(path: str) -> Column:
    """Every directory above a path, '.' for the top included."""
    return F.concat(F.array(F.lit(".")), F.filter(ancestors(path), lambda d: d != F.col(path)))


def built(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files (path) with ``built``: some module (dir, includes, excludes) above includes the file and doesn't exclude it, or none is above.

    Null or empty includes take in everything. Files meet modules by exploded ancestors.
    """
    places = files.select("path", above("path").alias("dirs")).distinct()
    held = places.withColumn("dir", F.explode("dirs")).join(modules, "dir")
    none = F.array().cast("array<string>")
    taken = (F.size(F.coalesce("includes", none)) == 0) | F.arrays_overlap("dirs", F.coalesce("includes", none))
    left_out = F.arrays_overlap("dirs", F.coalesce("excludes", none))
    said = held.groupBy("path").agg(F.max(F.coalesce(taken & ~left_out, F.lit(False))).alias("said"))
    return files.join(said, "path", "left").withColumn("built", F.coalesce("said", F.lit(True))).drop("said")


def vendored(files: DataFrame, upstream: list[tuple[str, str, bool]]) -> DataFrame:
    """files (path, package) with ``copy_of``: the longest whole-segment end of the path that a row of
    ``upstream`` (glob, package, packages below too) matches with the file's package; null for none."""
    def matches(end: Column) -> Column:
        hit = F.lit(False)
        for glob, package, below in upstream:
            pattern = "^" + "[^/]*".join(glob_regex(part)[5:-1] for part in glob.split("*")) + "$"  # * stays within a segment
            declared = F.col("package") == package
            if below:
                declared = declared | F.col("package").startswith(f"{package}.")
            hit = hit | (end.rlike(pattern) & declared)
        return F.coalesce(hit, F.lit(False))

    return files.withColumn("copy_of", F.get(F.filter(suffixes("path"), matches), F.lit(0)))  # suffixes run from the longest


def http_reached(declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """ref: what services of files served over HTTP reach. declarations: ref, kind, http; uses: src, dst (types and members that aren't nested types)."""
    return reachable(declarations.where("kind = 'service' and http").select(F.col("ref").alias("node")), uses).withColumnRenamed("node", "ref")


def classified(declarations: DataFrame, reached: DataFrame, closed: bool) -> DataFrame:
    """declarations (ref, kind, unknown_generation, explicit_json) with ``class_rank``."""
    marked = declarations.join(reached.select("ref", F.lit(True).alias("is_reached")).distinct(), "ref", "left")
    unsure = F.col("kind").isin("service", "rpc")
    for flag in ("is_reached", "unknown_generation", "explicit_json"):
        unsure = unsure | F.coalesce(F.col(flag), F.lit(False))
    rank = F.lit(CERTAIN) if closed else F.when(unsure, POSSIBLE).otherwise(PROBABLE)
    return marked.withColumn("class_rank", rank).drop("is_reached")


def enum_holds(values: DataFrame, defaults: bool = True) -> DataFrame:
    """ref, reason, priority: values (enum, open, place, number, ref) held as an open enum's first or for a number that another shares."""
    first = values.where("open").groupBy("enum").agg(F.min_by("ref", "place").alias("ref")).select("ref", F.lit("default-value").alias("reason"), F.lit(0).alias("priority"))
    shared = values.withColumn("n", F.count("*").over(Window.partitionBy("enum", "number"))).where("n > 1")
    shared = shared.select("ref", F.lit("shared-number").alias("reason"), F.lit(1).alias("priority"))
    return first.unionByName(shared) if defaults else shared


def unresolved_holds(declarations: DataFrame, unresolved: DataFrame) -> DataFrame:
    """ref, reason, priority: declarations (path: array, ref) whose member has a type that didn't resolve (unresolved: path of the type, one step longer)."""
    parents = unresolved.where("size(path) > 0").select(F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct()
    return declarations.join(parents, "path", "left_semi").select("ref", F.lit("unresolved-type").alias("reason"), F.lit(2).alias("priority"))


def option_reached(extensions: DataFrame, declarations: DataFrame, uses: DataFrame, members: DataFrame) -> DataFrame:
    """ref of the declarations that extensions set in options (ref) keep: along types used (src, dst) and, from messages and enums, their
    fields and values (members: src, dst). declarations: ref, kind."""
    kinds = declarations.select("ref", "kind")
    within = members.join(kinds.where("kind in ('message', 'enum')").select(F.col("ref").alias("src")), "src", "left_semi")
    within = within.join(kinds.where("kind in ('field', 'value')").select(F.col("ref").alias("dst")), "dst", "left_semi")
    known = uses.join(kinds.select(F.col("ref").alias("dst")), "dst", "left_semi")
    seeds = extensions.select("ref").join(kinds.select("ref"), "ref", "left_semi")
    return reachable(seeds.withColumnRenamed("ref", "node"), known.select("src", "dst").union(within.select("src", "dst"))).withColumnRenamed("node", "ref")


def explicit_json(declarations: DataFrame) -> DataFrame:
    """Declarations (ref, kind, options) with ``explicit_json``: a field that states json_name, or a value that states its JSON name."""
    said = F.when(F.col("kind").isin("field", "extension"), F.map_contains_key("options", "json_name")).when(F.col("kind") == "value", F.exists(F.map_keys("options"), lambda k: k.endswith("json_name") | k.endswith("enum_value)")))
    return declarations.withColumn("explicit_json", F.coalesce(said, F.lit(False)))


def root_findings(entries: DataFrame, document: str) -> DataFrame:
    """path, line, col, ref, message: a finding at the start of the declaring document for each unmatched root (entry)."""
    pattern = F.when(F.col("entry").rlike("[*?]"), "configured root pattern").otherwise("configured root")
    return entries.select(F.lit(document).alias("path"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.col("entry").alias("ref"), F.concat(pattern, F.lit(" matches no symbol of the inventory")).alias("message"))
