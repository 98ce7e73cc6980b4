"""Schema files in the Protocol Buffers language, read as relations.

Files are parsed one by one, so a folder of a hundred thousand is read by all executors;
what follows (imports, names, numbers, features) are joins over the rows. A file that
doesn't parse is one row with its first error and gives no declarations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans.tables import Tables

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fF]?|\d+[eE][+-]?\d+[fF]?|\d+[fF])|(?P<int>0[xX][0-9a-fA-F]+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>[{}()\[\]<>;=,.:+\-/])""",
    re.S,
)
SCALARS = frozenset("double float int32 int64 uint32 uint64 sint32 sint64 fixed32 fixed64 sfixed32 sfixed64 bool string bytes".split())  # fixed values: scalar types
MOST_NUMBER = 536870911  # fixed value: the largest field number
EMBEDDED = tuple(f"google/protobuf/{n}.proto" for n in "any api compiler/plugin descriptor duration empty field_mask source_context struct timestamp type wrappers cpp_features go_features java_features".split())  # fixed values: includes of the compiler

_DECL = pa.struct(
    [("path", pa.list_(pa.string())), ("kind", pa.string()), ("owner", pa.string()), ("place", pa.int32()), ("number", pa.int64()), ("label", pa.string()), ("type", pa.string()), ("key_type", pa.string()),
     ("oneof", pa.string()), ("extendee", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("end_line", pa.int32()), ("options", pa.map_(pa.string(), pa.string()))]
)
_RANGE = pa.struct([("owner", pa.string()), ("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("name", pa.string())])
_COMMENT = pa.struct([("line", pa.int32()), ("col", pa.int32()), ("alone", pa.bool_()), ("text", pa.string())])
_IMPORT = pa.struct([("path", pa.string()), ("modifier", pa.string())])
_FILE = [("path", pa.string()), ("package", pa.string()), ("syntax", pa.string()), ("imports", pa.list_(_IMPORT)), ("options", pa.map_(pa.string(), pa.string())), ("decls", pa.list_(_DECL)), ("ranges", pa.list_(_RANGE)), ("comments", pa.list_(_COMMENT)), ("error", pa.string())]
SCHEMA = (
    "path string, package string, syntax string, imports array<struct<path: string, modifier: string>>, options map<string, string>,"
    " decls array<struct<path: array<string>, kind: string, owner: string, place: int, number: bigint, label: string, type: string, key_type: string, oneof: string, extendee: string, line: int, col: int, end_line: int, options: map<string, string>>>,"
    " ranges array<struct<owner: string, kind: string, s: bigint, e: bigint, name: string>>, comments array<struct<line: int, col: int, alone: boolean, text: string>>, error string"
)


class Unparsed(ValueError):
    """A file's first error."""


class Reader:
    """One file's tokens and what is read from them."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int, int]] = []
        self.comments: list[dict] = []
        self.at = 0
        at, line, start, used = 0, 1, 0, False  # used: whether the line has a token already
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise Unparsed(f"{line}:{at - start + 1}: an open string or comment, or a mark that means nothing")
            kind, value = found.lastgroup, found[0]
            if kind == "line":
                self.comments.append({"line": line, "col": at - start + 1, "alone": not used, "text": value})
            elif kind not in ("space", "block"):
                self.tokens.append((kind, value, line, at - start + 1))
                used = True
            if breaks := value.count("\n"):
                line, start, used = line + breaks, at + value.rindex("\n") + 1, False
            at = found.end()
        self.package, self.syntax = "", "proto2"
        self.imports: list[dict] = []
        self.options: dict[str, str] = {}
        self.decls: list[dict] = []
        self.ranges: list[dict] = []
        self.file()

    # tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def fail(self, wanted: str) -> None:
        if self.at < len(self.tokens):
            _, value, line, col = self.tokens[self.at]
            raise Unparsed(f"{line}:{col}: {wanted} is wanted, not {value}")
        raise Unparsed(f"the file ends where {wanted} is wanted")

    def take(self, value: str = "", kind: str = "") -> str:
        if not self.tokens[self.at :] or (value and self.peek() != value) or (kind and self.kind() != kind):
            self.fail(value or kind)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def skip(self, value: str) -> bool:
        if self.peek() == value:
            self.at += 1
            return True
        return False

    def dotted(self) -> str:
        name = self.take() if self.peek() == "." else ""
        name += self.take(kind="name")
        while self.skip("."):
            name += "." + self.take(kind="name")
        return name

    def whole(self) -> int:
        sign = -1 if self.skip("-") else 1
        return sign * int(self.take(kind="int"), 0) if not re.fullmatch(r"0\d+", self.peek()) else sign * int(self.take(), 8)

    # options

    def option_name(self) -> str:
        parts = []
        while True:
            if self.skip("("):
                parts.append(f"({self.dotted()})")
                self.take(")")
            else:
                parts.append(self.take(kind="name"))
            if not self.skip("."):
                return ".".join(parts)

    def value(self) -> str:
        """An option's value as text; an aggregate with all in it."""
        if self.peek() in ("{", "<"):
            depth, text = 0, []
            while True:
                token = self.take()
                depth += (token in "{<[") - (token in "}>]")
                text.append(token)
                if not depth:
                    return " ".join(text)
        if self.peek() == "[":
            depth, text = 0, []
            while True:
                token = self.take()
                depth += (token in "[{") - (token in "]}")
                text.append(token)
                if not depth:
                    return " ".join(text)
        if self.kind() == "string":
            return self.string()
        sign = self.take() if self.peek() in ("-", "+") else ""
        if self.kind() not in ("int", "float", "name"):
            self.fail("a value")
        return sign + self.take()

    def string(self) -> str:
        text = ""
        while self.kind() == "string":
            text += re.sub(r"\\(x[0-9a-fA-F]{1,2}|[0-7]{1,3}|.)", _unescaped, self.take()[1:-1])
        return text

    def bracketed(self) -> dict[str, str]:
        found: dict[str, str] = {}
        if self.skip("["):
            while True:
                name = self.option_name()
                self.take("=")
                found[name] = self.value()
                if not self.skip(","):
                    break
            self.take("]")
        return found

    def option(self, into: dict[str, str]) -> None:
        self.take("option")
        name = self.option_name()
        self.take("=")
        into[name] = self.value()
        self.take(";")

    # declarations

    def declare(self, path: list[str], kind: str, start: int, **more) -> dict:
        _, _, line, col = self.tokens[start]
        owner = ".".join(path[:-1])
        row = {"path": path, "kind": kind, "owner": owner, "place": len(self.decls), "line": line, "col": col, "end_line": self.tokens[self.at - 1][2], "options": {}, **more}
        self.decls.append(row)
        return row

    def file(self) -> None:
        first = True
        while self.at < len(self.tokens):
            word = self.peek()
            if word in ("syntax", "edition") and first:
                self.at += 1
                self.take("=")
                self.syntax = self.string() or self.fail("a string")
                if word == "syntax" and self.syntax not in ("proto2", "proto3"):
                    raise Unparsed(f"the syntax {self.syntax} isn't known")
                self.take(";")
            elif word == "import":
                self.at += 1
                modifier = self.take() if self.peek() in ("public", "weak", "option") else None
                self.imports.append({"path": self.string() or self.fail("a string"), "modifier": modifier})
                self.take(";")
            elif word == "package":
                self.at += 1
                if self.package:
                    raise Unparsed("a second package")
                self.package = self.dotted()
                self.take(";")
            elif word == "option":
                self.option(self.options)
            elif not self.skip(";"):
                self.definition([])
            first = False

    def definition(self, path: list[str]) -> None:
        start = self.at
        if self.peek() in ("export", "local") and self.peek(1) in ("message", "enum"):
            self.at += 1
        word = self.peek()
        if word == "message":
            self.at += 1
            own = [*path, self.take(kind="name")]
            row = self.declare(own, "message", start)
            self.message(own, row)
        elif word == "enum":
            self.at += 1
            self.enum([*path, self.take(kind="name")], start)
        elif word == "extend":
            self.at += 1
            extendee = self.dotted()
            self.take("{")
            while not self.skip("}"):
                if not self.skip(";"):
                    self.field(path, extendee=extendee)
        elif word == "service" and not path:
            self.at += 1
            self.service([self.take(kind="name")], start)
        else:
            self.fail("a declaration")

    def ended(self, row: dict) -> None:
        row["end_line"] = self.tokens[self.at - 1][2]

    def message(self, path: list[str], row: dict) -> None:
        self.take("{")
        while not self.skip("}"):
            word = self.peek()
            if self.skip(";"):
                continue
            if word == "option" and self.peek(1) != "=":
                self.option(row["options"])
            elif word in ("message", "enum", "extend", "export", "local") and self.tokens[self.at + 1][0] == "name" and self.peek(2) in ("{", ".") or (word in ("export", "local") and self.peek(1) in ("message", "enum")):
                self.definition(path)
            elif word == "extend" and self.peek(1) == ".":
                self.definition(path)
            elif word == "oneof" and self.peek(2) == "{":
                self.at += 1
                start, name, options = self.at, self.take(kind="name"), {}
                oneof = self.declare([*path, name], "oneof", start)
                self.take("{")
                while not self.skip("}"):
                    if self.peek() == "option":
                        self.option(options)
                    elif not self.skip(";"):
                        self.field(path, oneof=name)
                oneof["options"] = options
                self.ended(oneof)
            elif word in ("extensions", "reserved") and self.peek(1) != "=" and self.peek(2) != "=":
                self.reserved(".".join(path), word, MOST_NUMBER + 1, 1)
            else:
                self.field(path)
        self.ended(row)

    def reserved(self, owner: str, word: str, most: int, past: int) -> None:
        """Ranges or names; past: what is added to a range's last number, none for an enum's."""
        self.take(word)
        while True:
            if self.kind() == "string":
                self.ranges.append({"owner": owner, "kind": word, "s": None, "e": None, "name": self.string()})
            elif self.kind() == "name":
                self.ranges.append({"owner": owner, "kind": word, "s": None, "e": None, "name": self.take()})
            else:
                low = self.whole()
                high = low
                if self.skip("to"):
                    high = most - past if self.skip("max") else self.whole()
                self.ranges.append({"owner": owner, "kind": word, "s": low, "e": high + past, "name": None})
            if not self.skip(","):
                break
        self.bracketed()
        self.take(";")

    def field(self, path: list[str], oneof: str | None = None, extendee: str | None = None) -> None:
        start = self.at
        label = self.take() if self.peek() in ("optional", "required", "repeated") and self.peek(1) != "=" else None
        if label and (oneof or self.peek() == "map" and self.peek(1) == "<"):
            raise Unparsed(f"{self.tokens[start][2]}:{self.tokens[start][3]}: a label where none may be")
        key_type = None
        if self.peek() == "map" and self.peek(1) == "<":
            self.at += 2
            key_type = self.take(kind="name")
            self.take(",")
            kind, label = self.dotted(), "repeated"
            self.take(">")
        else:
            kind = self.dotted()
        name = self.take(kind="name")
        self.take("=")
        number = self.whole()
        if not 1 <= number <= MOST_NUMBER:
            raise Unparsed(f"{self.tokens[start][2]}:{self.tokens[start][3]}: the field number {number} isn't in the range")
        options = self.bracketed()
        if kind == "group":
            group = self.declare([*path, name], "message", start)
            row = self.declare([*path, name.lower()], "extension" if extendee else "field", start, number=number, label=label, type=name, oneof=oneof, extendee=extendee)
            self.message([*path, name], group)
        else:
            self.take(";")
            row = self.declare([*path, name], "extension" if extendee else "field", start, number=number, label=label, type=kind, key_type=key_type, oneof=oneof, extendee=extendee)
        row["options"] = options

    def enum(self, path: list[str], start: int) -> None:
        row = self.declare(path, "enum", start)
        self.take("{")
        while not self.skip("}"):
            if self.skip(";"):
                continue
            if self.peek() == "option" and self.peek(1) != "=":
                self.option(row["options"])
            elif self.peek() == "reserved" and self.peek(1) != "=":
                self.reserved(".".join(path), "reserved", 1 << 31, 0)
            else:
                begun, name = self.at, self.take(kind="name")
                self.take("=")
                number = self.whole()
                options = self.bracketed()
                self.take(";")
                self.declare([*path, name], "value", begun, number=number)["options"] = options
        if not any(d["kind"] == "value" and d["path"][:-1] == path for d in self.decls[row["place"] :]):
            raise Unparsed(f"{row['line']}:{row['col']}: an enum without values")
        self.ended(row)

    def service(self, path: list[str], start: int) -> None:
        row = self.declare(path, "service", start)
        self.take("{")
        while not self.skip("}"):
            if self.skip(";"):
                continue
            if self.peek() == "option":
                self.option(row["options"])
                continue
            begun = self.at
            self.take("rpc")
            name = self.take(kind="name")
            types = []
            for word in ("", "returns"):
                if word:
                    self.take(word)
                self.take("(")
                if self.peek() == "stream" and self.peek(1) != ")":
                    self.at += 1
                types.append(self.dotted())
                self.take(")")
            options: dict[str, str] = {}
            if self.skip("{"):
                while not self.skip("}"):
                    if not self.skip(";"):
                        self.option(options)
            else:
                self.take(";")
            self.declare([*path, name], "rpc", begun, type=types[0], key_type=types[1])["options"] = options
        self.ended(row)


def _unescaped(m: re.Match) -> str:
    mark = m[1]
    if mark[0] == "x" and len(mark) > 1:
        return chr(int(mark[1:], 16))
    if mark[0] in "01234567":
        return chr(int(mark, 8) & 255)
    return {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}.get(mark, mark)


def parsed(docs: DataFrame) -> DataFrame:
    """A row per file (path, content) in the shape of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    r = Reader(content or "")
                    rows.append({"path": path, "package": r.package, "syntax": r.syntax, "imports": r.imports, "options": list(r.options.items()), "comments": r.comments, "error": None,
                                 "decls": [d | {"options": list(d["options"].items())} for d in r.decls], "ranges": r.ranges})
                except Unparsed as e:
                    rows.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FILE))

    return docs.select("path", "content").mapInArrow(run, SCHEMA)


def declarations(files: DataFrame) -> DataFrame:
    """A row per declaration: file, package, syntax, ref, full_name and the columns of the parser."""
    scope = F.concat(F.lit("proto://"), F.when(F.col("package") == "", ".").otherwise(F.col("package")), F.lit("#"))
    each = files.where("error is null").select(F.col("path").alias("file"), "package", "syntax", F.explode("decls").alias("d"))
    name = F.array_join("d.path", ".")
    full = F.when(F.col("package") == "", name).otherwise(F.concat("package", F.lit("."), name))
    # a value is a sibling of its enum
    parts = F.split(full, "[.]")
    sibling = F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 2), F.slice(parts, -1, 1)), ".")
    return each.select("file", "package", "syntax", F.concat(scope, name).alias("ref"), F.when(F.col("d.kind") == "value", sibling).otherwise(full).alias("full_name"), F.col("d.path").alias("names"), *[f"d.{c}" for c in
        ("kind", "owner", "place", "number", "label", "type", "key_type", "oneof", "extendee", "line", "col", "end_line", "options")])


def ranges(files: DataFrame) -> DataFrame:
    return files.where("error is null").select(F.col("path").alias("file"), F.explode("ranges").alias("r")).select("file", "r.*")


def comments(files: DataFrame) -> DataFrame:
    return files.where("error is null").select(F.col("path").alias("file"), F.explode("comments").alias("c")).select("file", "c.*")


def imports(files: DataFrame) -> DataFrame:
    return files.where("error is null").select(F.col("path").alias("file"), F.explode("imports").alias("i")).select("file", F.col("i.path").alias("imported"), "i.modifier")


def missing_imports(files: DataFrame) -> DataFrame:
    """file, imported of imports that name neither a file nor an include of the compiler."""
    return imports(files).where(~F.col("imported").isin(*EMBEDDED)).join(files.select(F.col("path").alias("imported")), "imported", "left_anti").select("file", "imported")


def closure(files: DataFrame) -> DataFrame:
    """file, reaches: every file that each one's imports lead to; a file that leads to itself is in a cycle."""
    arcs = imports(files).join(files.select(F.col("path").alias("imported")), "imported", "left_semi").select(F.col("file").alias("a"), F.col("imported").alias("b")).distinct()
    tables = Tables(files.sparkSession, "imports")
    arcs = tables.save(arcs)
    known = frontier = arcs.select(F.col("a").alias("file"), F.col("b").alias("reaches"))
    while not frontier.isEmpty():  # ends: every round adds pairs
        more = frontier.join(arcs, F.col("reaches") == F.col("a")).select("file", F.col("b").alias("reaches")).distinct()
        frontier = tables.save(more.join(known, ["file", "reaches"], "left_anti"))
        known = known.union(frontier)
    return known


def cyclic(files: DataFrame) -> DataFrame:
    """Files whose imports lead back to them."""
    return closure(files).where("file = reaches").select("file")


def unclean(files: DataFrame) -> DataFrame:
    """path, why of files that don't parse, import what isn't there, or are in a cycle; one is enough to withhold every finding."""
    why = files.where("error is not null").select("path", F.col("error").alias("why"))
    lacking = missing_imports(files).groupBy(F.col("file").alias("path")).agg(F.concat(F.lit("imports "), F.array_join(F.array_sort(F.collect_set("imported")), ", ")).alias("why"))
    loops = cyclic(files).select(F.col("file").alias("path"), F.lit("imports itself").alias("why"))
    return why.union(lacking).union(loops)


def symbols(files: DataFrame) -> DataFrame:
    """ord, full_name, kind, file of all declarations and packages, in the order of files and places, for the rules of names."""
    named = declarations(files).select("file", "place", "full_name", F.when(F.col("kind") == "value", "value").otherwise(F.col("kind")).alias("kind"))
    parts = F.split("package", "[.]")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")))
    packages = files.where("error is null and package <> ''").select(F.col("path").alias("file"), F.lit(-1).alias("place"), above.alias("full_name"), F.lit("package").alias("kind"))
    return named.unionByName(packages).select(F.struct("file", "place").alias("ord"), "full_name", "kind", "file")
