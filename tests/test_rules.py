"""Golden cases of text functions and of rules that the catalog's tables don't reach."""

from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import declarations, envelope, outcomes, settings, suppression
from tributary.sources import documents


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_columns_count_utf16_behind_tabs(spark):
    rows = spark.createDataFrame([("ab", 0, 1), ("ab", 2, 3), ("\tab", 8, 2), ("\tab", 9, 3), ("a\tb", 8, 3), ("a", 9, 2), ("", 4, 1)], "line string, stop int, want int")
    assert rows.where(names.utf16_column("line", "stop") != F.col("want")).count() == 0


def test_failure_lines(spark):
    text = F.lit("note: x\nsetup: missing: no file\nbroken: more: yes\nrun: odd line\r\nother: z")
    found = one(spark, lines=names.failure_lines(text, ["setup: ", "run: "], ["missing", "broken", "note"])).lines
    assert [(x.line, x["class"], x.detail) for x in found] == [("note: x", None, None), ("setup: missing: no file", "missing", "no file"), ("broken: more: yes", "broken", "more: yes"), ("run: odd line", "unreadable", None), ("other: z", None, None)]


def test_enum_prefixes_and_styles(spark):
    strip = lambda n, e: names.strip_enum_prefix(F.lit(n), F.lit(e))
    r = one(spark, a=strip("FOO_BAR_BAZ", "FooBar"), b=strip("FOOBAR", "FooBar"), c=strip("FOO_BA", "FooBar"), d=strip("foo_bar__x", "Foo_Bar"), e=names.lower_snake_style(F.lit("a__b")), f=names.upper_snake_style(F.lit("A_1")), g=names.title_style(F.lit("Ab1")), h=names.version_of(F.lit("v")))
    assert tuple(r) == ("BAZ", "FOOBAR", "FOO_BA", "x", "contains style violating underscores", "contains style violating underscores", None, "devel")


def test_json_names_in_two_passes(spark):
    rows = [("m", 1, "a_b", None, False), ("m", 2, "aB", None, False), ("m", 3, "c", "aB", False), ("m", 4, "d", "[x]", False), ("l", 1, "a_b", None, True), ("l", 2, "aB", None, True), ("l", 3, "c", "z", True), ("l", 4, "d", "z", True)]
    found = declarations.json_conflicts(spark.createDataFrame(rows, "owner string, place int, name string, custom string, legacy boolean"))
    assert sorted(tuple(r) for r in found.collect()) == [("l", 4, "custom", 3), ("m", 2, "default", 1), ("m", 3, "custom", 1), ("m", 4, "invalid", 0)]


def test_synthetic_oneofs_step_aside(spark):
    rows = [("m", 1, "a", True), ("m", 2, "_a", True), ("m", 3, "X_a", False), ("m", 4, "b", True)]
    fields = spark.createDataFrame(rows, "owner string, place int, name string, optional boolean")
    found = declarations.synthetic_oneofs(fields, spark.createDataFrame([("m", "_b")], "owner string, name string"))
    assert {r.place: r.oneof for r in found.collect()} == {1: "XX_a", 2: "XXX_a", 4: "X_b"}


def test_directives_bind_the_next_or_their_own_line(spark):
    comments = spark.createDataFrame([("f", 4, 1, True, ["A", "B"], "why"), ("f", 5, 9, False, ["A"], "why"), ("f", 9, 1, True, ["A"], "why"), ("f", 5, 9, False, ["C"], "")], "path string, line int, col int, alone boolean, codes array<string>, reason string")
    records, refusals = suppression.directives(comments, spark.createDataFrame([("f", 5, "s"), ("f", 5, "t"), ("g", 5, "u")], "path string, line int, symbol string"))
    assert sorted((r.line, r.code, r.symbol) for r in records.where("symbol is not null").collect()) == [(4, "A", "s"), (4, "A", "t"), (4, "B", "s"), (4, "B", "t"), (5, "A", "s"), (5, "A", "t")]
    assert [(r.line, r.code) for r in records.where("symbol is null").collect()] == [(9, "A")] and [(r.line, r.code) for r in refusals.collect()] == [(5, "C")]


def test_stale_suppressions_leave_out_unclean_files(spark):
    declared = spark.createDataFrame([("s", "f", "A", None, None), ("t", "f", "A", "exempt", None), ("u", "g", "A", None, "severity")], "ref string, path string, code string, held string, withheld_by string")
    records = spark.createDataFrame([("A", "s", "f", 1, 1), ("A", "t", "f", 2, 1), ("B", "s", "f", 2, 1), ("A", "u", "g", 3, 1)], "code string, symbol string, path string, line int, col int")
    held, stale = suppression.decided(declared, records, spark.createDataFrame([("g",)], "path string"))
    assert [r.ref for r in held.collect()] == ["s"]
    assert [tuple(r) for r in suppression.stale_sites(stale).collect()] == [("f", 2, 1, "A", "t", ["A", "B"])]


def test_unclean_file_withholds_all(spark):
    declared = spark.createDataFrame([("s", "own", "severity"), ("t", None, "confidence"), ("u", None, None)], "ref string, held string, withheld_by string")
    of = lambda unclean: {r.ref: r.held for r in suppression.withheld(declared, spark.createDataFrame(unclean, "path string")).collect()}
    assert of([]) == {"s": "own", "t": "withheld", "u": None} and of([("f",)]) == {"s": "own", "t": "unclean-file", "u": "unclean-file"}


def test_refused_settings_and_reports(spark):
    keys = spark.createDataFrame([("i", "integer"), ("s", "string")], "key string, type string")
    stated = spark.createDataFrame([("i", "1", "r"), ("i", "1.0", "r"), ("i", '"1"', "r"), ("s", '"x"', "r"), ("s", "1", "r"), ("z", "1", "r")], "key string, value string, source string")
    assert sorted(r.reason for r in settings.refused_values(stated, keys).collect()) == ["another type", "another type", "not a key", "not a whole number"]
    runs = spark.createDataFrame([("a", 0, "a", None), ("b", 3, "b", None), ("c", 1, "d", None), ("d", 4, "d", ["x"]), ("e", 0, None, None)], "name string, exit int, reported string, merged_from array<string>")
    assert {r.name: r.reason for r in documents.untrusted(runs).collect()} == {"b": "exit code", "c": "name", "d": "merged", "e": "no report"}


def test_collisions_need_two_inputs(spark):
    rows = [("configurations", "a", 1, "x"), ("configurations", "a", 2, "x"), ("configurations", "b", 1, "x"), ("configurations", "b", 2, "y"), ("configurations", "c", 1, "x"), ("configurations_not_built", "c", 1, "x"),
            ("configurations", "d", 1, "x"), ("configurations_not_built", "d", 2, "x"), ("consumers.loaded", "d", 3, "x")]
    found = envelope.id_collisions(spark.createDataFrame(rows, "array string, id string, input int, members string"))
    assert sorted((r.id, r.reason) for r in found.collect()) == [("b", "identity"), ("d", "state")]


def test_lines_of_omitted_and_failed_analyzers(spark):
    rows = [(1, "b", ["go"], False, False, [], []), (2, "a", ["ts"], True, False, [], []), (3, "c", ["py"], False, True, ["py"], ["x", "y"]), (4, "d", ["go"], False, True, [], [])]
    runs = spark.createDataFrame(rows, "ord int, name string, languages array<string>, setup_failed boolean, omitted boolean, left_out array<string>, dropped array<string>")
    assert [r.line for r in outcomes.lines(runs, "t").orderBy("place").collect()] == [
        't: to analyze the target without a, set analysis.languages: ["go"] or run b alone',
        't: c found no program, so the run leaves "py" out of scope, and with it the consumers x, y',
        "t: d found no program, so the run goes on without it",
    ]
