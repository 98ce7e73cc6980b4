"""What a run of analyzers came to: who failed or found nothing, what is said of it, and the exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import or_list, quoted
from tributary.operators.planning import by_name

REFUSED, FAILED = 2, 3  # fixed values: exit codes


def kinds(outcomes: DataFrame) -> DataFrame:
    """outcomes (name, exit, failures: array of struct class, setup) with ``setup_failed`` and ``no_program``: the failure code beside
    failures all of the setup group, and beside the one failure no-program."""
    failed = (F.col("exit") == FAILED) & (F.size("failures") > 0)
    setup = failed & F.forall("failures", lambda f: f["setup"])
    nothing = failed & (F.size("failures") == 1) & (F.element_at("failures", 1)["class"] == "no-program")
    return outcomes.withColumns({"setup_failed": F.coalesce(setup, F.lit(False)), "no_program": F.coalesce(nothing, F.lit(False))})


def exit_code(leaves: DataFrame) -> DataFrame:
    """run, exit: 2 if every leaf of a run's joined errors (run, refusal) is a refusal, else 3."""
    return leaves.groupBy("run").agg(F.when(F.min(F.col("refusal").cast("int")) == 1, REFUSED).otherwise(FAILED).alias("exit"))


def _with(dropped: Column) -> Column:
    return (
        F.when(F.size(dropped) == 0, "")
        .when(F.size(dropped) == 1, F.concat(F.lit(", and with it the consumer "), dropped[0]))
        .otherwise(F.concat(F.lit(", and with it the consumers "), F.array_join(dropped, ", ")))
    )


def lines(outcomes: DataFrame, product: str) -> DataFrame:
    """place, name, line: what is said beside what each analyzer printed, in the order of names.

    outcomes: ord, name, languages, setup_failed, omitted, left_out, dropped. Of an omitted one, what leaves
    the scope with it; of one that failed in its setup, how to do without: the languages of the
    analyzers that left a report but for its own, or those analyzers alone.
    """
    good = outcomes.where("not setup_failed and not omitted")
    names = good.agg(F.array_join(F.array_sort(F.collect_list("name")), " and ").alias("names"), F.count("*").alias("n"))  # one row; analyzers are as many as a configuration lists
    others = good.select(F.explode("languages").alias("language")).distinct()
    own = outcomes.where("setup_failed").select("ord", F.col("languages").alias("own"))
    rest = own.crossJoin(F.broadcast(others)).where(~F.array_contains("own", F.col("language"))).groupBy("ord").agg(quoted(F.array_sort(F.collect_set("language"))).alias("rest"))
    met = by_name(outcomes).join(rest, "ord", "left").crossJoin(F.broadcast(names))
    head = F.concat(F.lit(f"{product}: "), F.when(F.col("setup_failed"), F.concat(F.lit("to analyze the target without "), "name", F.lit(", "))).otherwise(F.concat("name", F.lit(" found no program, so the run "))))
    workaround = F.when(F.col("rest").isNull(), F.concat(F.lit("run "), "names", F.lit(" alone"))).otherwise(F.concat(F.lit("set analysis.languages: ["), "rest", F.lit("] or run "), "names", F.lit(" alone")))
    omission = F.when(F.size("left_out") == 0, F.lit("goes on without it")).otherwise(F.concat(F.lit("leaves "), quoted(F.col("left_out")), F.lit(" out of scope"), _with(F.col("dropped"))))
    said = F.when(F.col("setup_failed") & (F.col("n") > 0), F.concat(head, workaround)).when(F.col("omitted"), F.concat(head, omission))
    return met.select("place", "name", said.alias("line")).where("line is not null")


def remediation(failing: DataFrame, subjects: DataFrame) -> DataFrame:
    """place, line for each failing subject (place, code): its remedy and the places that can hold a suppression of it (subjects: code, names, remedy, places)."""
    met = failing.join(subjects, "code")
    rest = F.when(F.size("places") == 0, F.concat(F.lit("no suppression can name "), "names")).otherwise(F.concat(F.lit("or record an adjudication with its reason in "), or_list(F.col("places"))))
    return met.select("place", F.concat(F.lit("remediation: for each failing finding about "), "names", F.lit(": "), "remedy", F.lit("; "), rest).alias("line"))
