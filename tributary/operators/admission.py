"""Admission: each rule is a query whose rows are refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_conformant(inputs: DataFrame) -> DataFrame:
    return inputs.where("conformance <> 'pass'").select("ord", "name")


def with_omissions(inputs: DataFrame) -> DataFrame:
    return inputs.where("omitted > 0").select("ord", "name")


def repeated_names(inputs: DataFrame) -> DataFrame:
    """Names that several inputs bear, with how many and the first of them."""
    return inputs.groupBy("name").agg(F.count("*").alias("inputs"), F.min("ord").alias("first_ord")).where("inputs > 1")


def other_targets(inputs: DataFrame) -> DataFrame:
    """Inputs whose target (root and identity) isn't the first input's: linear, as the first offending pair always has it."""
    first = inputs.agg(F.min_by(F.struct("target_root", "target_identity"), "ord").alias("first"))
    other = ~(F.col("target_root").eqNullSafe(F.col("first.target_root")) & F.col("target_identity").eqNullSafe(F.col("first.target_identity")))
    return inputs.crossJoin(F.broadcast(first)).where(other).select("ord", "name", "target_root", "target_identity")  # one row


def collisions(rows: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Ids that stand for different things: key and in how many forms it occurs."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*identity)).alias("forms")).where("forms > 1")


def accepted_version(inputs: DataFrame, accepted: list[str]) -> DataFrame:
    return inputs.where(~F.col("version").isin(*accepted)).select("ord", "name", "version")
