"""Rules over the symbols, fields, enums and types of schema files, as joins and windows within their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.names import json_name, pascal_case, strip_enum_prefix

AGGREGATES = ("message", "enum", "service", "package")  # symbols that have members
TYPES = ("message", "enum")


def first_holders(symbols: DataFrame) -> DataFrame:
    """Of symbols (ord, full_name, kind, file) the first of each full name, which holds it."""
    return symbols.groupBy("full_name").agg(F.min_by(F.struct("ord", "kind", "file"), "ord").alias("first")).select("full_name", "first.*")


def taken_names(symbols: DataFrame) -> DataFrame:
    """ord, full_name, reason of symbols whose name an earlier one holds; a package may be declared again."""
    held = first_holders(symbols).select("full_name", F.col("ord").alias("first_ord"), F.col("kind").alias("first_kind"), F.col("file").alias("first_file"))
    later = symbols.join(held, "full_name").where("ord > first_ord and not (kind = 'package' and first_kind = 'package')")
    reason = (
        F.when(F.col("kind") == "package", F.concat(F.lit("not a package in file "), "first_file"))
        .when(F.col("file") != F.col("first_file"), F.concat(F.lit("in file "), "first_file"))
        .when(F.instr("full_name", ".") > 0, F.concat(F.lit("in "), F.regexp_replace("full_name", "[.][^.]*$", "")))
        .otherwise("at the top")
    )
    return later.select("ord", "full_name", reason.alias("reason"))


def scopes(relative_to: str) -> Column:
    """The enclosing scopes of a full name, the innermost first."""
    parts = F.split(relative_to, "[.]")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def looked_up(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """names (idx, name, relative_to) with ``found``, the full name that each means, and its kind; null for none.

    A leading dot is a full name. Otherwise the first part decides, from the innermost scope
    outward: a name of one part takes the first type, one of several the first symbol with
    members, within which the whole must then be; outside all scopes the name is a full one.
    """
    held = first_holders(symbols).select("full_name", "kind")
    absolute = F.startswith("name", F.lit("."))
    compound = F.instr("name", ".") > 0
    relative = names.where(~absolute & (F.instr("relative_to", ".") > 0))
    tried = relative.select("idx", "name", compound.alias("compound"), F.posexplode(scopes("relative_to")).alias("out", "scope"))
    first = tried.withColumn("full_name", F.concat("scope", F.lit("."), F.substring_index("name", ".", 1))).join(held, "full_name")
    decides = F.when(F.col("compound"), F.col("kind").isin(*AGGREGATES)).otherwise(F.col("kind").isin(*TYPES))
    inner = first.where(decides).groupBy("idx").agg(F.min_by("scope", "out").alias("scope"))
    wanted = names.join(inner, "idx", "left").withColumn(
        "full_name", F.when(absolute, F.expr("substr(name, 2)")).when(F.col("scope").isNotNull(), F.concat("scope", F.lit("."), "name")).otherwise(F.col("name"))
    )
    hit = held.select("full_name", F.col("full_name").alias("found"), "kind")
    return wanted.join(hit, "full_name", "left").select(*names.columns, "found", "kind")


def linked_types(fields: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fields (idx, name, relative_to, written: the type's written kind or null) with ``linked``, message or enum, or ``error``."""
    met = looked_up(fields.select("idx", "name", "relative_to"), symbols).select("idx", "found", "kind")
    joined = fields.join(met, "idx")
    kind = F.coalesce("written", F.when(F.col("kind").isin(*TYPES), F.col("kind")))
    error = (
        F.when(F.col("found").isNull(), "unresolved")
        .when(kind.isNull(), "not a type")
        .when((kind == "enum") & (F.col("kind") != "enum"), "not an enum type")
        .when((kind == "message") & (F.col("kind") != "message"), "not a message type")
    )
    return joined.select("idx", "found", F.when(error.isNull(), kind).alias("linked"), error.alias("error"))


def type_uses(names: DataFrame, types: DataFrame) -> DataFrame:
    """idx, uses: the references of resolved type names (idx, name: ``.pkg.Name``), each once, ascending. types: full_name, ref."""
    full = names.where(F.startswith("name", F.lit("."))).select("idx", F.expr("substr(name, 2)").alias("full_name"))
    return full.join(types, "full_name").groupBy("idx").agg(F.array_sort(F.collect_set("ref")).alias("uses"))


def taken_numbers(fields: DataFrame, extension_ranges: DataFrame) -> DataFrame:
    """owner, place, reason: fields (owner, place, number, is_extension) whose number an earlier one has, and extensions outside all of
    their owner's ranges (owner, s, e: half-open)."""
    first = fields.groupBy("owner", "number").agg(F.min("place").alias("first_place"))
    taken = fields.join(first, ["owner", "number"]).where("place > first_place").select("owner", "place", F.lit("taken").alias("reason"))
    numbered = fields.where("is_extension").select("owner", "place", "number")
    declared = numbered.join(extension_ranges.select(F.col("owner").alias("o"), "s", "e"), (F.col("owner") == F.col("o")) & (F.col("s") <= F.col("number")) & (F.col("number") < F.col("e")), "left_anti")
    return taken.union(declared.select("owner", "place", F.lit("not declared").alias("reason")))


def reserved_hits(values: DataFrame, ranges: DataFrame, names: DataFrame) -> DataFrame:
    """owner, place, reason of enum values (owner, place, number, name) in a reserved range (both ends inclusive) or with a reserved name."""
    by_number = values.join(ranges.select(F.col("owner").alias("o"), "s", "e"), (F.col("owner") == F.col("o")) & (F.col("s") <= F.col("number")) & (F.col("number") <= F.col("e")), "left_semi")
    by_name = values.join(names.select("owner", "name"), ["owner", "name"], "left_semi")
    return by_number.select("owner", "place", F.lit("number").alias("reason")).union(by_name.select("owner", "place", F.lit("name").alias("reason")))


def json_conflicts(fields: DataFrame) -> DataFrame:
    """owner, place, kind, other: fields (owner, place, name, custom, legacy) whose JSON name conflicts with an earlier field's.

    Two passes: default names alone, then custom ones where they differ. In the second, two
    default names aren't told again; under the legacy format only two custom names conflict.
    A custom name in brackets is invalid, told with 0 as the other, and takes part in nothing.
    """
    named = fields.select("owner", "place", "custom", "legacy", json_name("name").alias("default"))
    is_custom = F.col("custom").isNotNull() & (F.col("custom") != F.col("default"))
    invalid = is_custom & F.col("custom").rlike(r"(?s)^\[.*\]$")
    rows = named.select("owner", "place", "legacy", F.explode(F.array(
        F.struct(F.lit("default").alias("pass"), F.col("default").alias("json"), F.lit(False).alias("own"), F.lit(False).alias("invalid")),
        F.struct(F.lit("custom").alias("pass"), F.when(is_custom, F.col("custom")).otherwise(F.col("default")).alias("json"), F.coalesce(is_custom, F.lit(False)).alias("own"), F.coalesce(invalid, F.lit(False)).alias("invalid")),
    )).alias("r")).select("owner", "place", "legacy", "r.*")
    valid = rows.where("not invalid")
    first = valid.groupBy("owner", "pass", "json").agg(F.min_by(F.struct("place", "own"), "place").alias("first"))
    met = valid.join(first, ["owner", "pass", "json"]).where("place > first.place")
    told = met.where("not (pass = 'custom' and not own and not first.own) and not (legacy and (not own or not first.own))")
    return told.select("owner", "place", F.col("pass").alias("kind"), F.col("first.place").alias("other")).union(
        rows.where("invalid").select("owner", "place", F.lit("invalid"), F.lit(0))
    )


def enum_aliases(values: DataFrame) -> DataFrame:
    """enum, place, other, next_free: values (enum, place, number, allow_alias) that share an earlier one's number without leave, and the next number that none has."""
    islands = values.select("enum", "number").distinct().withColumn("island", F.col("number") - F.row_number().over(Window.partitionBy("enum").orderBy("number")))
    ends = islands.withColumn("next_free", F.max("number").over(Window.partitionBy("enum", "island")).cast("long") + 1).select("enum", "number", "next_free")
    first = values.groupBy("enum", "number").agg(F.min("place").alias("other"))
    return values.where("not allow_alias").join(first, ["enum", "number"]).where("place > other").join(ends, ["enum", "number"]).select("enum", "place", "other", "next_free")


def enum_name_conflicts(values: DataFrame) -> DataFrame:
    """enum, place, other: values (enum, enum_name, place, name, number) that agree with an earlier one of another name and number once the
    enum's name is stripped and the rest is Pascal case."""
    keyed = values.withColumn("key", pascal_case(strip_enum_prefix(F.col("name"), F.col("enum_name"))))
    first = keyed.groupBy("enum", "key").agg(F.min_by(F.struct("place", "name", "number"), "place").alias("first"))
    met = keyed.join(first, ["enum", "key"]).where("place > first.place and name <> first.name and number <> first.number")
    return met.select("enum", "place", F.col("first.place").alias("other"))


def open_enums_not_at_zero(values: DataFrame) -> DataFrame:
    """enum of open enums (enum, open, place, number) whose first value isn't zero."""
    first = values.where("open").groupBy("enum").agg(F.min_by("number", "place").alias("number"))
    return first.where("number <> 0").select("enum")


def field_refusals(fields: DataFrame) -> DataFrame:
    """owner, place, rule of what options a field's label, type and edition don't allow."""
    primitive = ~F.col("type").isin("string", "bytes", "message", "group")
    rules = {
        "lazy": (F.col("lazy") | F.col("unverified_lazy")) & (F.col("type") != "message"),
        "unverified_lazy extension": F.col("unverified_lazy") & F.col("is_extension"),
        "packed": F.col("packed") & ~((F.col("label") == "repeated") & primitive),
        "ctype": F.col("has_ctype") & (F.col("edition") >= 2024),
        "json_name on extension": F.col("is_extension") & F.col("custom").isNotNull() & (F.col("custom") != json_name("name")),
    }
    held = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(rule)) for rule, hit in rules.items()]))
    return fields.select("owner", "place", F.explode(held).alias("rule"))


def edition_defaults(files: DataFrame, defaults: DataFrame) -> DataFrame:
    """file, feature, value: for each file (file, edition) the value of the latest of the defaults (feature, since, value) not after its edition."""
    met = files.select("edition").distinct().join(defaults, F.col("since") <= F.col("edition"))
    latest = met.groupBy("edition", "feature").agg(F.max_by("value", "since").alias("value"))
    return files.join(latest, "edition").select("file", "feature", "value")


def inherited_features(elements: DataFrame, file_defaults: DataFrame) -> DataFrame:
    """path, feature, value: an element's (path, file, feature, value: its own or null) nearest own or enclosing value, else its file's default."""
    parts = F.split("path", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    own = elements.where("value is not null").select("file", F.col("path").alias("at"), "feature", "value")
    reached = elements.select("path", "file", "feature", F.posexplode(above).alias("depth", "at")).join(own, ["file", "at", "feature"])
    nearest = reached.groupBy("file", "path", "feature").agg(F.max_by("value", "depth").alias("nearest"))
    default = file_defaults.withColumnRenamed("value", "default")
    return elements.select("path", "file", "feature").join(nearest, ["file", "path", "feature"], "left").join(default, ["file", "feature"], "left").select(
        "path", "feature", F.coalesce("nearest", "default").alias("value")
    )


def synthetic_oneofs(fields: DataFrame, oneofs: DataFrame) -> DataFrame:
    """owner, place, oneof: the oneof of each optional field (owner, place, name, optional): its name behind an underscore, with as many X in
    front as make it new among the owner's fields, oneofs (owner, name) and the oneofs of earlier fields."""
    names = fields.select("owner", "name").union(oneofs.select("owner", "name")).groupBy("owner").agg(F.collect_set("name").alias("names"))
    base = F.when(F.startswith("name", F.lit("_")), F.col("name")).otherwise(F.concat(F.lit("_"), "name"))
    wanted = fields.where("optional").select("owner", "place", base.alias("base")).withColumn("turn", F.row_number().over(Window.partitionBy("owner", "base").orderBy("place")))
    spelled = F.transform(F.sequence(F.lit(0), F.size("names") + F.col("turn")), lambda k: F.concat(F.repeat(F.lit("X"), k), "base"))
    free = F.filter(spelled, lambda s: ~F.array_contains("names", s))
    return wanted.join(names, "owner").select("owner", "place", F.get(free, F.col("turn") - 1).alias("oneof"))


def map_entries(fields: DataFrame) -> DataFrame:
    """full_name, key_type, value_type of the entry message of each map field (owner, name, key_type, value_type)."""
    entry = F.concat("owner", F.lit("."), pascal_of("name"), F.lit("Entry"))
    return fields.where("key_type is not null").select(entry.alias("full_name"), "key_type", "value_type")


def pascal_of(name: str) -> Column:
    """An upper-case first letter and one behind each underscore, which go; other letters stay."""
    parts = F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.array_join(parts, "")


def positions(spans: DataFrame) -> DataFrame:
    """ref, line, col, end_line, one-based, of spans [line, column, end column] or [line, column, end line, end column]."""
    end = F.when(F.size("span") == 3, F.col("span")[0]).otherwise(F.col("span")[2])
    return spans.select("ref", (F.col("span")[0] + 1).alias("line"), (F.col("span")[1] + 1).alias("col"), (end + 1).alias("end_line"))


def declared(nodes: DataFrame) -> DataFrame:
    """ref, kind of declarations (package, path: names from the outermost, kind); map entries aren't declarations."""
    scope = F.concat(F.lit("proto://"), F.when(F.col("package") == "", ".").otherwise(F.col("package")), F.lit("#"))
    return nodes.where("kind <> 'map entry'").select(F.concat(scope, F.array_join("path", ".")).alias("ref"), "kind")
