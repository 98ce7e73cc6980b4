"""The readers of schema files and of the YAML subset, on hand-made files."""

import pytest

from tributary.operators import declarations as rules
from tributary.sources import proto_files as proto
from tributary.sources import yaml_subset as yaml

ORDERS = """// first line
syntax = "proto3";
package shop.v1;
import "shop/common.proto";
import public "google/protobuf/any.proto";
option java_package = "a" 'b';

/* block
   comment */
message Order { // trailing
  option deprecated = true;
  string order_id = 1 [json_name = "id", (my.opt).sub = { a: 1 b: [2, 3] }];
  optional int32 amount = 0x10;
  map<string, Line> lines = 3;
  repeated .shop.v1.Order.Line all = 4;
  oneof choice { bytes raw = 5; Common common = 6; }
  reserved 7, 9 to 11, 100 to max;
  reserved "old", 'older';
  message Line { Kind kind = 1; }
  enum Kind { option allow_alias = true; KIND_NONE = 0; KIND_A = 1; KIND_B = 1; reserved 5 to 6; }
}
service Shop {
  // alone
  rpc Get(Order) returns (stream Order.Line) { option (http) = { get: "/x" }; };
  rpc Put(stream Order) returns (Order);
}
"""
COMMON = """syntax = "proto2"; package shop.v1;
message Common { required string name = 1 [default = "x\\n\\"y\\x41"]; extensions 100 to 199; optional group Part = 2 { optional int64 n = 1; } }
extend Common { optional string tag = 126; }
message message { optional message message = 1; optional string option = 2; optional int32 reserved = 3; }
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("shop/orders.proto", ORDERS), ("shop/common.proto", COMMON), ("a.proto", 'import "b.proto"; message A { B b = 1; }'), ("b.proto", 'import "c.proto"; message B {}'), ("c.proto", 'import "a.proto"; message C {}'),
        ("d.proto", 'import "gone.proto"; import "a.proto"; message D {}'), ("bad.proto", "message X { string s = ; }"), ("open.proto", 'message X { string s = 1 [default = "'), ("empty.proto", ""), ("null.proto", None),
        ("range.proto", "message X { int32 a = 0; }"), ("enum.proto", "enum E { }"),
    ]
    return proto.parsed(spark.createDataFrame(rows, "path string, content string")).cache()


def test_declarations(files):
    rows = {r.ref: r for r in proto.declarations(files).where("file like 'shop/%'").collect()}
    order = "proto://shop.v1#Order"
    assert {k for k in rows if k.startswith(order)} == {order + x for x in ("", ".order_id", ".amount", ".lines", ".all", ".choice", ".raw", ".common", ".Line", ".Line.kind", ".Kind", ".Kind.KIND_NONE", ".Kind.KIND_A", ".Kind.KIND_B")}
    r = rows[f"{order}.order_id"]
    assert (r.kind, r.number, r.type, r.line, r.col, r.owner, r.options["json_name"]) == ("field", 1, "string", 12, 3, "Order", "id") and "(my.opt).sub" in r.options
    assert (rows[f"{order}.amount"].number, rows[f"{order}.amount"].label) == (16, "optional")
    assert (rows[f"{order}.lines"].key_type, rows[f"{order}.lines"].type) == ("string", "Line") and rows[f"{order}.raw"].oneof == "choice"
    assert (rows[order].line, rows[order].end_line, rows[order].options) == (10, 21, {"deprecated": "true"})
    assert rows[f"{order}.Kind.KIND_A"].full_name == "shop.v1.Order.KIND_A" and rows[f"{order}.Kind"].options == {"allow_alias": "true"}
    put = rows["proto://shop.v1#Shop.Put"]
    assert (put.kind, put.type, put.key_type) == ("rpc", "Order", "Order") and rows["proto://shop.v1#Shop.Get"].key_type == "Order.Line"
    assert rows["proto://shop.v1#Common.name"].options["default"] == 'x\n"yA' and rows["proto://shop.v1#tag"].extendee == "Common"
    assert rows["proto://shop.v1#Common.Part"].kind == "message" and rows["proto://shop.v1#Common.part"].type == "Part" and rows["proto://shop.v1#Common.Part.n"].kind == "field"
    assert rows["proto://shop.v1#message.message"].type == "message" and rows["proto://shop.v1#message.reserved"].number == 3


def test_ranges_and_comments(files):
    found = sorted(((r.owner, r.kind, r.s, r.e, r.name) for r in proto.ranges(files).collect()), key=str)
    assert found == sorted([("Order", "reserved", 7, 8, None), ("Order", "reserved", 9, 12, None), ("Order", "reserved", 100, proto.MOST_NUMBER + 1, None), ("Order", "reserved", None, None, "old"), ("Order", "reserved", None, None, "older"), ("Order.Kind", "reserved", 5, 6, None), ("Common", "extensions", 100, 200, None)], key=str)
    assert sorted((r.line, r.col, r.alone, r.text) for r in proto.comments(files).collect()) == [(1, 1, True, "// first line"), (10, 17, False, "// trailing"), (23, 3, True, "// alone")]


def test_unclean_files(files):
    why = {r.path: r.why for r in proto.unclean(files).collect()}
    assert set(why) == {"a.proto", "b.proto", "c.proto", "d.proto", "bad.proto", "open.proto", "range.proto", "enum.proto"}
    assert why["d.proto"] == "imports gone.proto" and why["a.proto"] == "imports itself" and why["bad.proto"].startswith("1:24: a value") or why["bad.proto"].startswith("1:24: int")
    assert {(r.file, r.reaches) for r in proto.closure(files).where("file in ('d.proto', 'shop/orders.proto')").collect()} == {("d.proto", "a.proto"), ("d.proto", "b.proto"), ("d.proto", "c.proto"), ("shop/orders.proto", "shop/common.proto")}


def test_names_resolve_over_files(files):
    symbols = proto.symbols(files).where("file like 'shop/%'")
    uses = proto.declarations(files).where("file like 'shop/%' and kind in ('field', 'extension')").selectExpr("full_name as idx", "type as name", "full_name as relative_to")
    found = {r.idx: r.found for r in rules.looked_up(uses, symbols).collect()}
    assert found["shop.v1.Order.lines"] == found["shop.v1.Order.all"] == "shop.v1.Order.Line" and found["shop.v1.Order.Line.kind"] == "shop.v1.Order.Kind"
    assert found["shop.v1.Order.common"] == "shop.v1.Common" and found["shop.v1.Order.order_id"] is None
    assert rules.taken_names(symbols).count() == 0


def test_yaml():
    assert yaml.parse("a: 1\nb:\n  - x\n  - y: 2\n    z: [q, 'r s', \"t\\n\"]\n  -\n    - deep\nc: 'it''s' # note\nd:\n- e\n\"k 1\": v # w\n") == {"a": "1", "b": ["x", {"y": "2", "z": ["q", "r s", "t\n"]}, ["deep"]], "c": "it's", "d": ["e"], "k 1": "v"}
    assert yaml.parse("---\n# only\nurl: http://x#y\n") == {"url": "http://x#y"} and yaml.parse("") == {} and yaml.parse("plain") == "plain"


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: !t 1", "a: |\n  x", "a: >\n  x", "a: {b: 1}", "a: [b, {c: 1}]", "a: 1\na: 2", "a: 'open", "a:\n\tb: 1", "a: 1\n---\nb: 2", "a: 1\n  b: 2", "? a\n: b", "a: [b"])
def test_yaml_outside_the_subset(text):
    with pytest.raises(yaml.Refused):
        yaml.parse(text)


def test_module_declarations(spark):
    rows = [("buf.yaml", "version: v2\nmodules:\n  - path: proto\n    excludes: [proto/gen]\n  - path: api\n    includes:\n      - api/v1\n"), ("sub/buf.yaml", "version: v1\nbuild:\n  excludes: [x]\n"), ("bad/buf.yaml", "version: {}\n")]
    read = yaml.entries(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r.config, r.dir, r.includes, r.excludes) for r in yaml.module_rows(read).collect()) == [("buf.yaml", "api", ["api/v1"], []), ("buf.yaml", "proto", [], ["proto/gen"]), ("sub/buf.yaml", "sub", [], ["x"])]
    assert [(r.path, r.refusal) for r in read.where("refusal is not null").collect()] == [("bad/buf.yaml", "a flow map")]
