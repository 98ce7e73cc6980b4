"""The merged envelope: unions and sums over inputs, their order and what refuses them, numbers of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.plans.tables import Tables

INPUT_ORDER = ("name", "version", "digest", "schema_version", "conformance", "omitted", "target_kind", "language_kinds", "languages", "target_root", "target_identity")
PAIRED = {"configurations": "configurations_not_built", "consumers.loaded": "consumers.unavailable"}


def record_union(inputs: list[DataFrame]) -> DataFrame:
    """Notes, skips and other records of all inputs, equal ones once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs).distinct()


def summed(totals: DataFrame) -> DataFrame:
    """Suppressions in effect, recorded reasons and withheld findings, summed over the inputs."""
    return totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("in_effect", "reasons", "probable", "possible")])


def ordered_inputs(inputs: DataFrame) -> DataFrame:
    """Adds ``place`` in merged_from's order: by every member that admission reads, so no refusal depends on the order given."""
    return inputs.withColumn("place", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in INPUT_ORDER if c in inputs.columns])))  # as many rows as inputs


def numbered(rows: DataFrame, order: list[str], into: str = "number") -> DataFrame:
    """Adds numbers from 1 on in order, however many rows: each range of the order counts its own and starts where the ones before end."""
    spark = rows.sparkSession
    tables = Tables(spark, "numbered")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tables.save(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn(into, F.col("_start") + own).drop("_part", "_start")


def minted(records: DataFrame, checks: DataFrame, prefix: str) -> DataFrame:
    """ref, id of the records (ord, ref, held) that nothing holds, numbered in their order, and of the checks (ord, ref) behind them."""
    pending = records.where("held is null").select(F.lit(0).alias("kind"), "ord", "ref")
    each = pending.unionByName(checks.select(F.lit(1).alias("kind"), "ord", "ref"))
    return numbered(each, ["kind", "ord", "ref"]).select("ref", F.concat(F.lit(f"{prefix}/c-"), F.col("number").cast("string")).alias("id"))


def carriers(records: DataFrame, graded: DataFrame) -> DataFrame:
    """idx, ref, component, class_rank, carried: the finding of each dead schema record at its promoted class (graded: idx, promoted_rank),
    that of each dead implementer, and the findings that implementers carry besides (array of ref)."""
    schema = records.where("role = 'schema' and state = 'dead'").join(graded.select("idx", "promoted_rank"), "idx").select("idx", "ref", "component", F.col("promoted_rank").alias("class_rank"), F.lit(False).alias("carried"))
    dead = records.where("role = 'implementer' and state = 'dead'")
    own = dead.select("idx", "ref", "component", "class_rank", F.lit(False).alias("carried"))
    more = dead.select("idx", F.explode("carried").alias("ref"), "component", "class_rank", F.lit(True).alias("carried"))
    return schema.unionByName(own).unionByName(more)


def debited(counts: DataFrame, debits: DataFrame) -> DataFrame:
    """counts (component, symbols, deletable) less what blocked findings take (component, symbols, lines)."""
    less = debits.select("component", F.col("symbols").alias("less_symbols"), F.col("lines").alias("less_lines"))
    return counts.join(less, "component", "left").select("component", (F.col("symbols") - F.coalesce("less_symbols", F.lit(0))).alias("symbols"), (F.col("deletable") - F.coalesce("less_lines", F.lit(0))).alias("deletable"))


def id_collisions(entries: DataFrame) -> DataFrame:
    """array, id, reason: ids that two inputs list in one array under other members (identity), or one in an array and another in its pair (state).

    entries: input, array, id, members. One aggregate an id, no pairs of inputs.
    """
    same = entries.groupBy("array", "id").agg(F.count_distinct("members").alias("forms"), F.count_distinct("input").alias("inputs")).where("forms > 1 and inputs > 1")
    pair = F.create_map(*(F.lit(x) for k, v in PAIRED.items() for x in (v, k)))
    sides = entries.select("id", "input", F.coalesce(pair[F.col("array")], "array").alias("array"), pair[F.col("array")].isNotNull().cast("int").alias("side"))
    held = sides.groupBy("array", "id").agg(*[f(F.when(F.col("side") == s, F.col("input"))).alias(f"{n}{s}") for s in (0, 1) for n, f in (("low", F.min), ("high", F.max))])
    # some input on one side and another on the other
    other = held.where("low0 is not null and low1 is not null and not (low0 = high0 and low1 = high1 and low0 = low1)")
    return same.select("array", "id", F.lit("identity").alias("reason")).union(other.select("array", "id", F.lit("state")))


def kind_clashes(claims: DataFrame) -> DataFrame:
    """language of claims (input, language, kind) to which two inputs give different kinds."""
    return claims.groupBy("language").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1").select("language", "kinds")


def fact_refusals(facts: DataFrame, inputs: DataFrame, findings: DataFrame) -> DataFrame:
    """input, reason of facts (input, name, version, language, components, refs) that their report refuses, the first reason of each.

    inputs: input, name, version, languages; findings: input, component, ref.
    """
    own = inputs.select("input", F.col("name").alias("own_name"), F.col("version").alias("own_version"), "languages")
    named = findings.select("input", F.explode(F.array("component", "ref")).alias("value")).distinct()
    shared = facts.select("input", F.explode(F.concat("components", "refs")).alias("value")).join(named, ["input", "value"], "left_semi").select("input", F.lit(True).alias("shares")).distinct()
    reason = (
        F.when((F.col("name") != F.col("own_name")) | (F.col("version") != F.col("own_version")), "analyzer")
        .when(~F.array_contains("languages", F.col("language")), "language")
        .when(F.col("shares"), "finding")
    )
    return facts.join(own, "input").join(shared, "input", "left").select("input", reason.alias("reason")).where("reason is not null")


def no_inputs(inputs: DataFrame) -> DataFrame:
    """One row, ``refused``, if there is no input at all."""
    return inputs.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no input").alias("refused"))


def ordered_notes(notes: DataFrame) -> DataFrame:
    """Adds ``place`` in the order of notes: kind, path, key, message, a missing one first."""
    return numbered(notes, ["kind", "path", "key", "message"], "place")


def empty_merge(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """The report of no input: one row of empty arrays and zero totals, over a target of the kind given."""
    none = F.array().cast("array<string>")
    arrays = ("merged_from", "languages", "configurations", "findings", "edge_evaluations", "stale_suppressions", "notes")
    return spark.range(1).select(F.lit(kind).cast("string").alias("target_kind"), *[none.alias(c) for c in arrays], *[F.lit(0).cast("bigint").alias(c) for c in ("n_findings", "deletable_lines", "pending", "omitted")])
