"""Line intervals, totals, severity policy and the cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_lines(spans: DataFrame, by: list[str]) -> DataFrame:
    """Lines covered by ``[line, end_line]`` intervals, once each, per ``by``: islands of overlapping spans, no exploding."""
    unique = spans.select(*by, "path", "line", "end_line").distinct()
    before = Window.partitionBy(*by, "path").orderBy("line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_line").over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end_line") - F.greatest(F.col("line") - 1, reach))
    return unique.withColumn("new", new).groupBy(*by).agg(F.sum("new").alias("lines"))


def totals(findings: DataFrame) -> DataFrame:
    """Counts by severity; a component's deletable lines count once, where it has a root."""
    names = ("allow", "warn", "deny")
    each = findings.groupBy("component").agg(
        F.count("*").alias("findings"), *[F.count_if(F.col("severity_rank") == i).alias(name) for i, name in enumerate(names)], F.max(F.when(F.col("root") == 1, F.col("deletable"))).alias("lines")
    )
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("findings", *names)], F.coalesce(F.sum("lines"), F.lit(0)).alias("deletable_lines"))


def cap(findings: DataFrame, most: int, order: list) -> DataFrame:
    """The first ``most`` in ``order``; a top-k, merged from each partition's own."""
    return findings.orderBy(*order).limit(most)


def severity_of(findings: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds ``configured``: the level set for the finding's code, else for its family (its first three characters), else null."""
    exact = levels.select(F.col("code").alias("c"), F.col("level").alias("exact"))
    family = levels.select(F.col("code").alias("f"), F.col("level").alias("family"))
    looked = findings.join(exact, F.col("code") == F.col("c"), "left").join(family, F.substring("code", 1, 3) == F.col("f"), "left")
    return looked.withColumn("configured", F.coalesce("exact", "family")).drop("c", "exact", "f", "family")


def restate(findings: DataFrame, levels: DataFrame) -> DataFrame:
    """Findings with their severity restated: only those that no analyzer reported (analyzer is empty) take a configured one, and
    leave the report where it is allow (0). What an analyzer reported, it has already restated."""
    looked = severity_of(findings, levels)
    own = (F.col("analyzer") == "") & F.col("configured").isNotNull()
    return looked.where(~(own & (F.col("configured") == 0))).withColumn("severity_rank", F.when(own, F.col("configured")).otherwise(F.col("severity_rank"))).drop("configured")


def carried_by(carriers: DataFrame) -> DataFrame:
    """Of findings by canonical key (ref, path, line, end_line) and the component of each record that carries them: those of several components."""
    each = carriers.select("ref", "path", "line", "end_line", "component").distinct()
    several = each.groupBy("ref", "path", "line", "end_line").agg(F.count("*").alias("k")).where("k > 1")
    return each.join(several, ["ref", "path", "line", "end_line"])


def shared_line_correction(carriers: DataFrame, labels: DataFrame) -> DataFrame:
    """label, symbols, lines: what a joined set's summed counts hold too often.

    For findings that several of the set's components carry: one symbol for each component
    beyond the first, and each line they span once for each component beyond the first that
    spans it: distinct lines by component, summed, less distinct lines of all together.
    """
    shared = carried_by(carriers).join(labels, "component")
    # a finding's components are all joined, so it is in one set
    symbols = shared.select("label", "ref", "path", "line", "end_line", "k").distinct().groupBy("label").agg(F.sum(F.col("k") - 1).alias("symbols"))
    each = distinct_lines(shared, ["label", "component"]).groupBy("label").agg(F.sum("lines").alias("summed"))
    together = distinct_lines(shared, ["label"])
    return symbols.join(each, "label").join(together, "label").select("label", "symbols", (F.col("summed") - F.col("lines")).alias("lines"))


def unpromoted_debit(findings: DataFrame, blocked: DataFrame) -> DataFrame:
    """component, symbols, lines: what blocked findings (ref) take from a component that keeps others: their number and the lines only they span."""
    marked = findings.join(blocked.select("ref", F.lit(True).alias("is_blocked")).distinct(), "ref", "left").withColumn("is_blocked", F.coalesce("is_blocked", F.lit(False)))
    counts = marked.groupBy("component").agg(F.count_if("is_blocked").alias("symbols"), F.count_if(~F.col("is_blocked")).alias("kept")).where("symbols > 0 and kept > 0")
    every = distinct_lines(marked, ["component"])
    left = distinct_lines(marked.where("not is_blocked"), ["component"]).withColumnRenamed("lines", "kept_lines")
    return counts.join(every, "component").join(left, "component").select("component", "symbols", (F.col("lines") - F.col("kept_lines")).alias("lines"))


def failing_subjects(findings: DataFrame, fail_on: int, vocabulary: DataFrame) -> DataFrame:
    """place, code of the vocabulary's subjects (place, code) that a finding at or above ``fail_on`` has; before any cap."""
    held = findings.where(F.col("severity_rank") >= fail_on).select("code").distinct()
    return vocabulary.join(held, "code", "left_semi").select("place", "code")


def capped_report(findings: DataFrame, most: int, order: list, canonical: list[str]) -> tuple[DataFrame, DataFrame]:
    """The findings that the cap keeps, with their place in canonical order, and one row, ``omitted``: how many it leaves out."""
    kept = cap(findings, most, order)
    place = Window.orderBy(*canonical)  # as many rows as the cap
    omitted = findings.agg(F.greatest(F.count("*") - F.lit(most), F.lit(0)).cast("bigint").alias("omitted"))
    return kept.withColumn("place", F.row_number().over(place)), omitted


def verdict(findings: DataFrame, fail_on: int) -> DataFrame:
    """Exit code 1 if a finding is at or above ``fail_on``, else 0."""
    return findings.agg(F.when(F.count_if(F.col("severity_rank") >= fail_on) > 0, 1).otherwise(0).alias("exit_code"))
