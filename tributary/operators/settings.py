"""Configuration: ranked sources, resolved per key, with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(settings: DataFrame) -> DataFrame:
    """key, value, source: for each key the value of the strongest source (lowest rank), the earliest of equal ones; nulls don't count."""
    best = settings.where("value is not null").groupBy("key").agg(F.min_by(F.struct("value", "source"), F.struct("source_rank", "seq")).alias("s"))
    return best.select("key", "s.value", "s.source")


def missing(settings: DataFrame, required: DataFrame) -> DataFrame:
    """Required keys (key) that no source supplies."""
    return required.join(settings.where("value is not null"), "key", "left_anti")


def overridden(settings: DataFrame) -> DataFrame:
    """For each key how many sources supply it and how many of those lose."""
    return settings.where("value is not null").groupBy("key").agg(F.count_distinct("source").alias("sources"), (F.count_distinct("source") - 1).alias("losing"))


def keyed(members: DataFrame) -> DataFrame:
    """section, name, value, source: each member of a keyed section (section, name, value, source, source_rank) from the strongest source that names it."""
    best = members.groupBy("section", "name").agg(F.min_by(F.struct("value", "source"), "source_rank").alias("s"))
    return best.select("section", "name", "s.value", "s.source")


def with_defaults(resolved: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value, source of every key (key, default): resolved, else its default; keys with neither are missing, see :func:`missing`."""
    met = keys.join(resolved, "key", "left")
    source = F.when(F.col("source").isNotNull(), F.col("source")).when(F.col("default").isNotNull(), "default")
    return met.select("key", F.coalesce("value", "default").alias("value"), source.alias("source")).where("source is not null")


def refused_values(stated: DataFrame, keys: DataFrame) -> DataFrame:
    """key, source, reason of stated settings (key, value: JSON text, source): of no known key, of another type than the key's (key, type), or
    an integer that isn't written whole."""
    met = stated.join(keys.select("key", "type"), "key", "left")
    kind = (
        F.when(F.col("value").rlike('^"'), "string").when(F.col("value").isin("true", "false"), "boolean").when(F.col("value").rlike("^[-0-9]"), "number")
        .when(F.col("value").rlike(r"^\["), "array").when(F.col("value").rlike("^[{]"), "object").otherwise("null")
    )
    whole = F.col("value").rlike("^-?(0|[1-9][0-9]*)$")
    reason = (
        F.when(F.col("type").isNull(), "not a key")
        .when((F.col("type") == "integer") & (kind == "number") & ~whole, "not a whole number")
        .when(F.when(F.col("type") == "integer", "number").otherwise(F.col("type")) != kind, "another type")
    )
    return met.select("key", "source", reason.alias("reason")).where("reason is not null")


def repeated_providers(providers: DataFrame) -> DataFrame:
    """source, place, name of providers (source, place, name) that an earlier entry of their list names."""
    first = providers.groupBy("source", "name").agg(F.min("place").alias("first_place"))
    return providers.join(first, ["source", "name"]).where("place > first_place").select("source", "place", "name")


def delivered(resolved: DataFrame, routing: DataFrame, languages: list[str]) -> DataFrame:
    """key, value of the settings that any of the languages reads (routing: key, language)."""
    read = routing.where(F.col("language").isin(*languages)).select("key").distinct()
    return resolved.join(read, "key", "left_semi").select("key", "value")


def assembled(sources: list[tuple[str, DataFrame]], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The settings of ranked sources (name, stated: key, value), the strongest first, and the refusals of those that aren't valid."""
    every = None
    for rank, (name, stated) in enumerate(sources):
        one = stated.select("key", "value", F.lit(name).alias("source"), F.lit(rank).alias("source_rank"), F.lit(0).alias("seq"))
        every = one if every is None else every.unionByName(one)
    return every, refused_values(every, keys)
