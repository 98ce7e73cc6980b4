"""Generation configurations, plugins, import roots and shadowed schema files, by exploded ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.schema_rules import above


def plugin_name(entry: Column, known: list[str], other: str = "other") -> Column:
    """The known plugin that an entry of a generation configuration names: its last path step, without a version; ``other`` for none."""
    base = F.regexp_replace(F.regexp_replace(entry, "@.*$", ""), "^.*/", "")
    short = F.regexp_replace(base, "^protoc-gen-", "")
    match = F.lit(other)
    for p in reversed(known):
        match = F.when((base == p) | (F.concat(F.lit("protoc-gen-"), short) == p) | (short == p.replace("-", "_")), p).otherwise(match)
    return match


def remote_name(ref: Column) -> Column:
    """The plugin's name in a remote reference, its version dropped."""
    return F.regexp_replace(F.regexp_replace(ref, ":.*$", ""), "^.*/", "")


def coverage(files: DataFrame, configs: DataFrame, generators: DataFrame, http_plugins: list[str], analyzed: list[str]) -> DataFrame:
    """path, http, unknown: what all configurations (dir, plugins, unknown) above a file say of it; a file under none is unknown.

    A plugin is unknown unless a generator row (plugin, language) says that it writes a language that is analyzed.
    """
    written = generators.where(F.col("language").isin(*analyzed)).select("plugin", F.lit(True).alias("read")).distinct()
    each = configs.select("dir", "unknown", F.explode_outer("plugins").alias("plugin")).join(F.broadcast(written), "plugin", "left")
    said = each.groupBy("dir").agg(
        F.max(F.coalesce(F.col("plugin").isin(*http_plugins), F.lit(False))).alias("http"),
        F.max(F.col("unknown") | (F.col("plugin").isNotNull() & F.col("read").isNull())).alias("unknown"),
    )
    met = files.select("path", F.explode(above("path")).alias("dir")).join(said, "dir").groupBy("path").agg(F.max("http").alias("http"), F.max("unknown").alias("unknown"))
    return files.select("path").distinct().join(met, "path", "left").select("path", F.coalesce("http", F.lit(False)).alias("http"), F.coalesce("unknown", F.lit(True)).alias("unknown"))


def import_paths(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, import_path, held: a file's path below the first import root (rank, dir) above it, else as it is."""
    met = files.select("path", F.explode(above("path")).alias("dir")).join(roots, "dir")
    first = met.groupBy("path").agg(F.min_by("dir", "rank").alias("dir"))
    below = F.when(F.col("dir") == ".", F.col("path")).otherwise(F.expr("substr(path, length(dir) + 2)"))
    return files.select("path").distinct().join(first, "path", "left").select("path", F.coalesce(below, "path").alias("import_path"), F.col("dir").isNotNull().alias("held"))


def resolved_imports(files: DataFrame, roots: DataFrame) -> DataFrame:
    """import_path, winner: the file that an import path names, below the first root that has one."""
    met = files.select("path", F.explode(above("path")).alias("dir")).join(roots, "dir")
    below = F.when(F.col("dir") == ".", F.col("path")).otherwise(F.expr("substr(path, length(dir) + 2)"))
    return met.select("path", "rank", below.alias("import_path")).groupBy("import_path").agg(F.min_by("path", "rank").alias("winner"))


def shadowed(files: DataFrame, roots: DataFrame, embedded: DataFrame) -> DataFrame:
    """path, read: schema files whose import path names another file, or, if no root holds them, an include (import_path) of the compiler."""
    placed = import_paths(files, roots).join(resolved_imports(files, roots), "import_path", "left")
    known = placed.join(embedded.select("import_path", F.lit(True).alias("is_embedded")).distinct(), "import_path", "left")
    other = F.col("winner").isNotNull() & (F.col("winner") != F.col("path"))
    read = (
        F.when(other & F.col("held"), F.concat("winner", F.lit(" under an earlier import root")))
        .when(other, F.concat("winner", F.lit(" under an import root")))
        .when(~F.col("held") & F.col("is_embedded"), F.concat("import_path", F.lit(" in the compiler's own include directory")))
    )
    return known.select("path", read.alias("read")).where("read is not null")


def first_locations(locations: DataFrame) -> DataFrame:
    """file, path, line: the first location (file, path, ord, line) of each declaration path."""
    return locations.groupBy("file", "path").agg(F.min_by("line", "ord").alias("line"))


def empty_outputs(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """config, dir of output directories (config, dir, ending) that hold no file of their plugin's ending."""
    held = files.select(F.explode(above("path")).alias("dir"), F.regexp_extract("path", "([.][^./]*)$", 1).alias("ending")).distinct()
    return outputs.join(held, ["dir", "ending"], "left_anti").select("config", "dir")
