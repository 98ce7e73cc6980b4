"""The subset of YAML that configuration files use: block maps and sequences, flow sequences, plain and quoted scalars.

Anchors, aliases, tags, block scalars, flow maps, complex keys, tabs in indents and several
documents are refused by name. Scalars are text; a key without a value is an empty scalar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", " ": " ", "_": "\xa0", "N": "\x85", "L": "\u2028", "P": "\u2029"}
_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#"'\[\]{},&*!|>%@`-][^#\n]*?|-[^\s#][^#\n]*?)\s*:(?=\s|$)""")


class Refused(ValueError):
    """A construct outside the subset."""


def _unquoted(text: str) -> tuple[str, str]:
    """A quoted scalar's text, and what follows it."""
    if text[0] == "'":
        found = re.match(r"'((?:''|[^'])*)'", text)
        if not found:
            raise Refused("an open quote")
        return found[1].replace("''", "'"), text[found.end() :]
    found = re.match(r'"((?:\\.|[^"\\])*)"', text)
    if not found:
        raise Refused("an open quote")

    def one(m: re.Match) -> str:
        mark = m[1]
        if mark[0] in "xuU":
            return chr(int(mark[1:], 16))
        if mark not in _ESCAPES:
            raise Refused(f"the escape \\{mark}")
        return _ESCAPES[mark]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, found[1]), text[found.end() :]


def _scalar(text: str):
    text = text.strip()
    if not text:
        return ""
    refused = {"&": "an anchor", "*": "an alias", "!": "a tag", "|": "a block scalar", ">": "a block scalar", "{": "a flow map", "%": "a directive", "@": "a reserved mark", "`": "a reserved mark", "?": "a complex key"}
    if text[0] in refused and not (text[0] == "?" and len(text) > 1 and text[1] != " "):
        raise Refused(refused[text[0]])
    if text[0] == "[":
        items, rest = _flow(text)
        if rest.strip() and not rest.strip().startswith("#"):
            raise Refused("text behind a flow sequence")
        return items
    if text[0] in "\"'":
        value, rest = _unquoted(text)
        if rest.strip() and not re.match(r"\s+#", rest):
            raise Refused("text behind a quoted scalar")
        return value
    return re.split(r"\s#", text, maxsplit=1)[0].strip()


def _flow(text: str) -> tuple[list, str]:
    items, at = [], text[1:].lstrip()
    while not at.startswith("]"):
        if not at:
            raise Refused("an open flow sequence")
        if at[0] == "[":
            value, at = _flow(at)
        elif at[0] in "\"'":
            value, at = _unquoted(at)
        else:
            found = re.match(r"[^,\[\]{}#]*", at)
            value, at = _scalar(found[0]), at[found.end() :]
            if not found[0]:
                raise Refused("a flow map" if at[:1] in "{}" else "an empty item")
        items.append(value)
        at = at.lstrip()
        if at.startswith(","):
            at = at[1:].lstrip()
        elif not at.startswith("]"):
            raise Refused("a flow map" if at.startswith("{") else "an open flow sequence")
    return items, at[1:]


def parse(text: str):
    """A document as dicts, lists and strings."""
    lines = []
    for line in text.removeprefix("\ufeff").splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = line[: len(line) - len(line.lstrip())]
        if "\t" in indent:
            raise Refused("a tab in an indent")
        if bare == "---" and not lines:
            continue
        if bare in ("---", "..."):
            raise Refused("a second document")
        lines.append((len(indent), line.strip()))
    if not lines:
        return {}
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise Refused("an indent that fits nothing")
    return value


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    if lines[at][1] == "-" or lines[at][1].startswith("- "):
        items = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
            rest = lines[at][1][1:]
            inner = indent + 1 + len(rest) - len(rest.lstrip())
            if not rest.strip() or rest.strip().startswith("#"):
                at += 1
                if at < len(lines) and lines[at][0] > indent:
                    value, at = _block(lines, at, lines[at][0])
                else:
                    value = ""
            elif _KEY.match(rest.strip()) or rest.strip().startswith("- "):
                lines[at] = (inner, rest.strip())
                value, at = _block(lines, at, inner)
            else:
                value, at = _scalar(rest), at + 1
            items.append(value)
        return items, at
    if not _KEY.match(lines[at][1]):
        return _scalar(lines[at][1]), at + 1
    found: dict = {}
    while at < len(lines) and lines[at][0] == indent:
        key = _KEY.match(lines[at][1])
        if not key:
            raise Refused("a line that is no key")
        name = _scalar(key[1])
        if name in found:
            raise Refused("a repeated key")
        rest = lines[at][1][key.end() :].strip()
        at += 1
        if rest and not rest.startswith("#"):
            found[name] = _scalar(rest)
        elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")))):
            found[name], at = _block(lines, at, lines[at][0])
        else:
            found[name] = ""
    return found, at


def _leaves(value, at: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, (*at, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, (*at, str(i)))
    else:
        yield ".".join(at), value


def entries(docs: DataFrame) -> DataFrame:
    """path, key (names and places joined by dots), value of every scalar in documents (path, content); a refused document is one row with its refusal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, key, value, None) for key, value in _leaves(parse(content or ""))]
                except Refused as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "key", "value", "refusal"])

    return docs.select("path", "content").mapInPandas(run, "path string, key string, value string, refusal string")


def module_rows(read: DataFrame) -> DataFrame:
    """config, dir, includes, excludes of the modules that module configurations (rows of :func:`entries`) declare.

    Version v2 lists modules with their own paths, includes and excludes; others are one module at the file's folder.
    """
    from pyspark.sql import functions as F

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    v2 = read.where("key rlike '^modules[.][0-9]+[.](path|includes[.][0-9]+|excludes[.][0-9]+)$'")
    parts = v2.select("path", F.split("key", "[.]").alias("k"), "value").select("path", F.col("k")[1].alias("place"), F.col("k")[2].alias("name"), "value")
    of = lambda name: F.collect_list(F.when(F.col("name") == name, F.col("value")))
    listed = parts.groupBy("path", "place").agg(F.max(F.when(F.col("name") == "path", F.col("value"))).alias("dir"), of("includes").alias("includes"), of("excludes").alias("excludes"))
    whole = read.where("key = 'version'").join(v2.select("path").distinct(), "path", "left_anti")
    ignored = read.where("key rlike '^build[.]excludes[.][0-9]+$'").groupBy("path").agg(F.collect_list("value").alias("excludes"))
    none = F.array().cast("array<string>")
    alone = whole.join(ignored, "path", "left").select("path", F.lit(".").alias("dir"), none.alias("includes"), F.coalesce("excludes", none).alias("excludes"))
    every = listed.select("path", F.coalesce("dir", F.lit(".")).alias("dir"), "includes", "excludes").unionByName(alone)
    joined = F.when(folder == "", F.col("dir")).when(F.col("dir") == ".", folder).otherwise(F.concat(folder, F.lit("/"), "dir"))
    return every.select(F.col("path").alias("config"), joined.alias("dir"), "includes", "excludes")
