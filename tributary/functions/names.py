"""Names, references and text as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_name(name: str | Column) -> Column:
    """lower_snake to lowerCamel: an underscore goes and the character behind it is upper-cased."""
    parts = F.split(_column(name), "_")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(parts[0], F.array_join(rest, ""))


def pascal_case(name: str | Column) -> Column:
    """UPPER_SNAKE to Pascal."""
    return F.array_join(F.transform(F.split(_column(name), "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def strip_enum_prefix(name: Column, enum_name: Column) -> Column:
    """An enum value's name without the enum's own in front, whatever the case and underscores, unless nothing would be left."""
    bare = F.regexp_replace(enum_name, "_", "")
    pattern = F.concat(F.lit("(?i)^_*"), F.array_join(F.split(bare, "(?!^)"), "_*"), F.lit("_*"))
    rest = F.regexp_replace(name, pattern, F.lit(""))
    return F.when((bare == "") | (rest == ""), name).otherwise(rest)


def _style(name: Column, shape: str, first: str, should: str, begin: str, underscores: bool) -> Column:
    said = F.when(name == "", "is empty").when(~name.rlike(shape), should).when(~name.rlike(first), begin)
    return said.when(name.rlike("^_|_$|__|_[^A-Za-z]"), "contains style violating underscores") if underscores else said


def title_style(name: str | Column) -> Column:
    """Why a name isn't TitleCase; null if it is."""
    return _style(_column(name), "^[A-Za-z0-9]+$", "^[A-Z]", "should be TitleCase", "should begin with a capital letter", False)


def lower_snake_style(name: str | Column) -> Column:
    """Why a name isn't lower_snake_case (dots allowed); null if it is."""
    return _style(_column(name), "^[a-z0-9_.]+$", "^[a-z]", "should be lower_snake_case", "should begin with a lower case letter", True)


def upper_snake_style(name: str | Column) -> Column:
    """Why a name isn't UPPER_SNAKE_CASE; null if it is."""
    return _style(_column(name), "^[A-Z0-9_]+$", "^[A-Z]", "should be UPPER_SNAKE_CASE", "should begin with an upper case letter", True)


def or_list(items: Column) -> Column:
    """Items as text: a, b or c."""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" or "), F.element_at(items, -1)))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def quoted(items: Column) -> Column:
    """Each item in quotes, with commas between."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", ")


def version_of(stamped: str | Column, devel: str = "devel") -> Column:
    """A module version without its v; ``devel`` for what is none."""
    c = _column(stamped)
    return F.when(c.rlike("(?s)^v."), F.substr(c, F.lit(2))).otherwise(F.lit(devel))


def utf16_column(before: str | Column, column: str | Column) -> Column:
    """The one-based UTF-16 column of a place on an ASCII line, for which a tab goes to the next multiple of eight.

    before: the line's text; column: the zero-based column with tab stops.
    """
    line, stop = _column(before), _column(column)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("col"))
    step = lambda a, c: F.when(a["col"] >= stop, a).otherwise(F.struct((a["at"] + 1).alias("at"), F.when(c == "\t", a["col"] + 8 - a["col"] % 8).otherwise(a["col"] + 1).alias("col")))
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda a: a["at"] + 1)


def quoted_lines(text: str | Column, analyzer: str | Column) -> Column:
    """An analyzer's lines, each with its name in front unless it already is there."""
    head = F.concat(_column(analyzer), F.lit(": "))
    lines = log_lines(text)
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.transform(whole, lambda x: F.when(F.startswith(x, head), x).otherwise(F.concat(head, x)))


def failure_lines(text: str | Column, prefixes: list[str], classes: list[str]) -> Column:
    """What an analyzer printed as structs (line, class, detail): a prefixed line of a known class is a failure, and behind the first such
    also a bare one; class is 'unreadable' for a prefixed line of no class, and null for all others."""
    lines = F.filter(log_lines(text), lambda x: x != "")
    cut = "^(?:" + "|".join(p.replace("(", "[(]").replace(")", "[)]") for p in prefixes) + ")"
    known = lambda x: F.substring_index(x, ": ", 1).isin(*classes) & (F.instr(x, ": ") > 0)
    first = F.aggregate(F.transform(lines, lambda x, i: F.when(x.rlike(cut), i)), F.lit(1 << 30), lambda a, i: F.least(a, F.coalesce(i, F.lit(1 << 30))))
    def read(x: Column, i: Column) -> Column:
        bare = F.regexp_replace(x, cut, "")
        kind = F.when(known(bare) & (x.rlike(cut) | (i > first)), F.substring_index(bare, ": ", 1)).when(x.rlike(cut), "unreadable")
        return F.struct(x.alias("line"), kind.alias("class"), F.when(kind.isNotNull() & (kind != "unreadable"), F.substr(bare, F.instr(bare, ": ") + 2)).alias("detail"))

    return F.transform(lines, read)


def scheme(ref: str | Column) -> Column:
    """What stands before ``://``; null without it."""
    c = _column(ref)
    return F.when(F.instr(c, "://") > 0, F.substring_index(c, "://", 1))


def digest(content: str | Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_column(content), 256))


def log_lines(text: str | Column) -> Column:
    """Lines that end in CR, LF or both."""
    return F.split(_column(text), "\r\n|\r|\n")
