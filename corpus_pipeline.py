"""A corpus pipeline: five operators, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage's rows are written as Parquet and
read again as the next one's documents; so when a stage begins, the folders that the
one before worked in are deleted.

Defined cases: null and empty texts fail the quality rules; rows with null or repeated ids
and extra columns, whatever their names, are passed on as each operator says; an empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tributary.llm.decontaminate import drop_contaminated
from tributary.llm.mixing import mix
from tributary.llm.ngram_join import keep_one
from tributary.llm.quality_rules import keep_good
from tributary.llm.shared import Scratch, opened, release, table
from tributary.llm.token_store import tokens_of

_left: list[Scratch] = []  # folders of the stage before, whose rows are written by now


def _stage(operator: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(operator)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            worked_in = _left.pop()
            worked_in.spark = spark  # the session of the stage before may have ended
            worked_in.drop()
        release(spark)
        with opened() as found:
            kept = operator(spark, docs, sf_dir)
        if operator.__name__ != "tokens":  # nothing comes behind the last stage, so its files stay
            _left.extend(found)
        return kept

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens_of(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token output", tokens),
]

#: The learned rules and the tokenizer have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
