"""Path rules as equi-joins: suffixes and ancestors are exploded, so no join compares all pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(path: str) -> Column:
    """Every whole-segment suffix of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def ancestors(path: str) -> Column:
    """Every whole-segment prefix of a path, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def same_file(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_path, right_path) of which one is the other or a whole-segment suffix of it."""
    a, b = left.select(F.col("path").alias("left_path")).distinct(), right.select(F.col("path").alias("right_path")).distinct()
    long_left = a.select("left_path", F.explode(suffixes("left_path")).alias("right_path")).join(b, "right_path", "left_semi")
    long_right = b.select("right_path", F.explode(suffixes("right_path")).alias("left_path")).join(a, "left_path", "left_semi")
    return long_left.select("left_path", "right_path").union(long_right.select("left_path", "right_path")).distinct()


def nearest_ancestor(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """path and the longest of ``dirs`` (dir) above it, null where there is none."""
    above = files.select("path", F.posexplode(ancestors("path")).alias("depth", "dir")).join(dirs, "dir")
    best = above.groupBy("path").agg(F.max_by("dir", "depth").alias("dir"))
    return files.select("path").distinct().join(best, "path", "left")


def common_directory(paths: DataFrame, by: list[str]) -> DataFrame:
    """The deepest directory that all of a group's paths share."""
    sizes = paths.groupBy(*by).agg(F.count("*").alias("n"))
    held = paths.select(*by, F.posexplode(ancestors("path")).alias("depth", "dir")).groupBy(*by, "depth", "dir").agg(F.count("*").alias("k"))
    best = held.join(sizes, by).where("k = n").groupBy(*by).agg(F.max_by("dir", "depth").alias("dir"))
    return sizes.select(*by).join(best, by, "left").withColumn("dir", F.coalesce("dir", F.lit("")))


def glob_regex(glob: str) -> str:
    """A pattern in which * is any run, ? one code point, and all else itself."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in "\\.+^$()[]{}|" else c) for c in glob) + "$"


class Language(NamedTuple):
    """What puts a language in scope: files of these names, or with these endings but not these names, outside these directories."""

    markers: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    skipped_dirs: tuple[str, ...] = ()
    skipped_files: tuple[str, ...] = ()


def census(files: DataFrame, rules: dict[str, Language]) -> DataFrame:
    """For each language of ``rules`` that any file counts for: how many do. A directory hides its files from its own language only."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = []
    for language, rule in rules.items():
        source = F.lit(False)
        for e in rule.endings:
            source = source | F.col("path").endswith(e)
        counts = name.isin(*rule.markers) | (source & ~name.isin(*rule.skipped_files))
        rows.append(F.when(counts & ~F.arrays_overlap(dirs, F.array(*map(F.lit, rule.skipped_dirs)).cast("array<string>")), F.lit(language)))
    return files.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("language")).groupBy("language").agg(F.count("*").alias("files"))
