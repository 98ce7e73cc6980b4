"""Queries over schema declarations, planning, suppressions, the envelope and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import accounting, declarations, envelope, generation, outcomes, planning, schema_rules, settings, suppression
from tributary.registry import query, read
from tributary.relations import derive
from tributary.sources import documents, proto_files, yaml_subset

# symbols, fields and enums of schema files

_FIRST = "/*with*/ first as (select full_name, arg_min(ord, ord) ord, arg_min(kind, ord) kind, arg_min(file, ord) file from symbols group by full_name)"


@query(f"""{_FIRST} select s.ord, s.full_name, case when s.kind = 'package' then 'not a package in file ' || f.file when s.file <> f.file then 'in file ' || f.file
 when contains(s.full_name, '.') then 'in ' || regexp_replace(s.full_name, '[.][^.]*$', '') else 'at the top' end reason
from symbols s join first f using (full_name) where s.ord > f.ord and not (s.kind = 'package' and f.kind = 'package')""", "symbols")
def taken_names(spark, sf_dir):
    return declarations.taken_names(derive(spark, sf_dir, "symbols"))


_LOOKUP = _FIRST + """,
parts as (select *, string_split(relative_to, '.') p, string_split(name, '.') q from type_names),
steps as (select idx, name, len(q) > 1 compound, array_to_string(p[1:i], '.') scope, i, q[1] head from (select *, unnest(range(1, len(p))) i from parts where not starts_with(name, '.'))),
hits as (select s.idx, s.scope, s.i from steps s join first f on f.full_name = s.scope || '.' || s.head
  where case when compound then f.kind in ('message', 'enum', 'service', 'package') else f.kind in ('message', 'enum') end),
best as (select idx, arg_max(scope, i) scope from hits group by idx),
wanted as (select t.idx, t.name, t.relative_to, t.written, case when starts_with(t.name, '.') then substr(t.name, 2) when b.scope is not null then b.scope || '.' || t.name else t.name end w from type_names t left join best b using (idx)),
met as (select w.*, f.full_name as found, f.kind from wanted w left join first f on f.full_name = w.w)"""


@query(f"{_LOOKUP} select idx, found, kind from met", "symbols", "type_names")
def scoped_lookup(spark, sf_dir):
    return declarations.looked_up(derive(spark, sf_dir, "type_names"), derive(spark, sf_dir, "symbols")).select("idx", "found", "kind")


@query(f"""{_LOOKUP}, e as (select idx, found, coalesce(written, case when kind in ('message', 'enum') then kind end) k, kind from met),
r as (select idx, found, k, case when found is null then 'unresolved' when k is null then 'not a type' when k = 'enum' and kind <> 'enum' then 'not an enum type' when k = 'message' and kind <> 'message' then 'not a message type' end error from e)
select idx, found, case when error is null then k end linked, error from r""", "symbols", "type_names")
def linked_types(spark, sf_dir):
    return declarations.linked_types(derive(spark, sf_dir, "type_names"), derive(spark, sf_dir, "symbols"))


@query(f"""{_FIRST}, n as (select idx % 500 as idx, substr(name, 2) full_name from type_names where starts_with(name, '.')), t as (select full_name, 'proto://' || replace(full_name, '.M', '#M') as ref from first where kind in ('message', 'enum'))
select idx, string_agg(distinct ref, ',' order by ref) uses from n join t using (full_name) group by idx""", "symbols", "type_names")
def type_uses(spark, sf_dir):
    types = declarations.first_holders(derive(spark, sf_dir, "symbols")).where("kind in ('message', 'enum')").select("full_name", F.concat(F.lit("proto://"), F.replace("full_name", F.lit(".M"), F.lit("#M"))).alias("ref"))
    used = derive(spark, sf_dir, "type_names").select((F.col("idx") % 500).alias("idx"), "name")
    return declarations.type_uses(used, types).select("idx", F.array_join("uses", ",").alias("uses"))


@query("""/*with*/ f as (select owner, number, min(place) p from fields group by owner, number)
select owner, place, 'taken' reason from fields join f using (owner, number) where place > p
union all select owner, place, 'not declared' from fields x where is_extension and not exists (select 1 from ranges r where 'M' || r.owner = x.owner and r.s <= x.number and x.number < r.e)""", "fields", "ranges")
def taken_numbers(spark, sf_dir):
    declared = derive(spark, sf_dir, "ranges").select(F.concat(F.lit("M"), "owner").alias("owner"), "s", "e")
    return declarations.taken_numbers(derive(spark, sf_dir, "fields"), declared)


@query("""select enum as owner, place, 'number' reason from enum_values v where exists (select 1 from ranges r where 'E' || r.owner = v.enum and r.s <= v.number and v.number <= r.e)
union all select enum, place, 'name' from enum_values where name = 'ON'""", "enum_values", "ranges")
def reserved_values(spark, sf_dir):
    values = derive(spark, sf_dir, "enum_values").withColumnRenamed("enum", "owner")
    held = derive(spark, sf_dir, "ranges").select(F.concat(F.lit("E"), "owner").alias("owner"), "s", "e")
    return declarations.reserved_hits(values, held, values.select("owner", F.lit("ON").alias("name")).distinct())


_JSON = """/*with*/ d as (select owner, place, custom, legacy, list_reduce(list_concat([''], string_split(name, '_')), lambda a, x: a || case when a = '' and not starts_with(name, '_') then x else upper(x[1:1]) || x[2:] end) dflt from fields),
n as (select *, custom is not null and custom <> dflt own from d),
r as (select owner, place, legacy, 'default' kind, dflt json, false own from n union all select owner, place, legacy, 'custom', case when own then custom else dflt end, own from n where not (own and custom like '[%]')),
g as (select owner, kind, json, min(place) other, arg_min(own, place) other_own from r group by owner, kind, json)"""


@query(f"""{_JSON} select owner, place, kind, other from r join g using (owner, kind, json) where place > other
and not (kind = 'custom' and not own and not other_own) and not (legacy and (not own or not other_own))
union all select owner, place, 'invalid', 0 from n where own and custom like '[%]'""", "fields")
def json_conflicts(spark, sf_dir):
    return declarations.json_conflicts(derive(spark, sf_dir, "fields"))


@query("""/*with*/ f as (select enum, number, min(place) other from enum_values group by enum, number)
select v.enum, v.place, f.other, (select min(n) from range(0, 40) t(n) where n > v.number and n not in (select number from enum_values w where w.enum = v.enum)) next_free
from enum_values v join f using (enum, number) where not allow_alias and v.place > f.other""", "enum_values")
def enum_aliases(spark, sf_dir):
    return declarations.enum_aliases(derive(spark, sf_dir, "enum_values"))


@query("""/*with*/ s as (select *, regexp_replace(name, case when enum_name = 'Mode' then '(?i)^_*m_*o_*d_*e_*' else '(?i)^_*s_*o_*m_*e_*k_*i_*n_*d_*' end, '') rest from enum_values),
k as (select *, list_reduce(list_concat([''], string_split(case when rest = '' then name else rest end, '_')), lambda a, x: a || upper(x[1:1]) || lower(x[2:])) as key from s),
f as (select enum, key, min(place) other, arg_min(name, place) other_name, arg_min(number, place) other_number from k group by enum, key)
select enum, place, other from k join f using (enum, key) where place > other and name <> other_name and number <> other_number""", "enum_values")
def enum_name_conflicts(spark, sf_dir):
    return declarations.enum_name_conflicts(derive(spark, sf_dir, "enum_values"))


@query("select enum from enum_values where open group by enum having arg_min(number, place) <> 0", "enum_values")
def open_enums_not_at_zero(spark, sf_dir):
    return declarations.open_enums_not_at_zero(derive(spark, sf_dir, "enum_values"))


@query("""/*with*/ j as (select *, list_reduce(list_concat([''], string_split(name, '_')), lambda a, x: a || case when a = '' and not starts_with(name, '_') then x else upper(x[1:1]) || x[2:] end) dflt from fields)
select owner, place, 'lazy' as rule from j where (lazy or unverified_lazy) and type <> 'message' union all select owner, place, 'unverified_lazy extension' from j where unverified_lazy and is_extension
union all select owner, place, 'packed' from j where packed and not (label = 'repeated' and type not in ('string', 'bytes', 'message', 'group')) union all select owner, place, 'ctype' from j where has_ctype and edition >= 2024
union all select owner, place, 'json_name on extension' from j where is_extension and custom <> dflt""", "fields")
def field_refusals(spark, sf_dir):
    return declarations.field_refusals(derive(spark, sf_dir, "fields"))


_DEFAULTS = [("presence", 998, "legacy"), ("presence", 2023, "explicit"), ("encoding", 998, "expanded"), ("encoding", 999, "packed"), ("utf8", 1000, "none"), ("utf8", 2024, "verify")]
_DEFAULT_SQL = ", ".join(f"('{f}', {e}, '{v}')" for f, e, v in _DEFAULTS)


@query(f"""/*with*/ files as (select distinct owner as file, edition from fields), d(feature, since, value) as (values {_DEFAULT_SQL})
select file, feature, arg_max(value, since) as value from files join d on since <= edition group by file, feature""", "fields")
def edition_defaults(spark, sf_dir):
    files = derive(spark, sf_dir, "fields").select(F.col("owner").alias("file"), "edition").distinct()
    return declarations.edition_defaults(files, spark.createDataFrame(_DEFAULTS, "feature string, since int, value string"))


@query(f"""/*with*/ el as (select owner as file, owner || '.' || place path, case when packed then 'own' end as value from fields union all select distinct owner, owner, case when legacy then 'file' end from fields),
files as (select distinct owner as file, edition from fields), d(feature, since, value) as (values {_DEFAULT_SQL}),
dflt as (select file, arg_max(value, since) dv from files join d on since <= edition where feature = 'encoding' group by file),
up as (select file, value uv from el where path = file)
select path, 'encoding' feature, coalesce(el.value, uv, dv) as value from el left join up using (file) left join dflt using (file)""", "fields")
def inherited_features(spark, sf_dir):
    """A field's own feature, else its message's, else the edition's default."""
    fields = derive(spark, sf_dir, "fields")
    own = fields.selectExpr("owner as file", "owner || '.' || place as path", "'encoding' as feature", "case when packed then 'own' end as value")
    above = fields.selectExpr("owner as file", "owner as path", "'encoding' as feature", "case when legacy then 'file' end as value").distinct()
    files = fields.select(F.col("owner").alias("file"), "edition").distinct()
    defaults = declarations.edition_defaults(files, spark.createDataFrame(_DEFAULTS, "feature string, since int, value string"))
    return declarations.inherited_features(own.union(above), defaults)


@query("""/*with*/ n as (select owner, list(distinct name) names from fields group by owner),
w as (select owner, place, case when starts_with(name, '_') then name else '_' || name end base, row_number() over (partition by owner, case when starts_with(name, '_') then name else '_' || name end order by place) turn from fields where optional)
select owner, place, list_filter(list_transform(range(0, 20), lambda k: repeat('X', k) || base), lambda s: not list_contains(names, s))[turn] oneof from w join n using (owner)""", "fields")
def synthetic_oneofs(spark, sf_dir):
    fields = derive(spark, sf_dir, "fields")
    return declarations.synthetic_oneofs(fields, fields.select("owner", "name").where("false"))


@query("""select distinct owner || '.' || list_reduce(list_concat([''], string_split(name, '_')), lambda a, x: a || upper(x[1:1]) || x[2:]) || 'Entry' full_name, key_type, type as value_type from fields where key_type is not null""", "fields")
def map_entries(spark, sf_dir):
    return declarations.map_entries(derive(spark, sf_dir, "fields").withColumnRenamed("type", "value_type")).distinct()


@query("""select 's' || l_orderkey || '/' || l_linenumber || '/' || l_partkey as ref, l_linenumber + 1 as line, cast(l_quantity as int) + 1 as col, case when l_suppkey % 2 = 0 then l_linenumber + 1 else l_linenumber + 3 end as end_line from lineitem""")
def source_positions(spark, sf_dir):
    spans = read(spark, sf_dir, "lineitem").selectExpr("'s' || l_orderkey || '/' || l_linenumber || '/' || l_partkey as ref",
        "case when l_suppkey % 2 = 0 then array(l_linenumber, cast(l_quantity as int), 90) else array(l_linenumber, cast(l_quantity as int), l_linenumber + 2, 1) end as span")
    return declarations.positions(spans)


@query("""select distinct 'proto://' || case when l_partkey % 5 = 0 then '.' else 'p' || (l_partkey % 5) end || '#M' || l_orderkey || '.f' || l_linenumber as ref, case when l_suppkey % 3 = 0 then 'field' else 'message' end kind from lineitem where l_suppkey % 3 <> 1""")
def declaration_rows(spark, sf_dir):
    nodes = read(spark, sf_dir, "lineitem").selectExpr("case when l_partkey % 5 = 0 then '' else 'p' || (l_partkey % 5) end as package", "array('M' || l_orderkey, 'f' || l_linenumber) as path",
        "case l_suppkey % 3 when 0 then 'field' when 1 then 'map entry' else 'message' end as kind")
    return declarations.declared(nodes).distinct()


# planning

_VOCABULARY = "select * from (values (0, 'AUTOMOBILE', false, true, 'a0'), (1, 'BUILDING', true, false, 'a1'), (2, 'FURNITURE', false, true, 'a2'), (3, 'n4', true, false, 'a3'), (4, 'n2', false, false, 'a4'), (5, 'HOUSEHOLD', false, true, 'a5')) t(place, language, in_process, takes_kind, analyzer)"
_HOLDS = "select c_custkey as path, array(c_mktsegment, 'n' || (c_nationkey % 9)) as holds from customer"
_HOLDS_SQL = "h as (select c_custkey as path, [c_mktsegment, 'n' || (c_nationkey % 9)] as holds from customer)"
_PLAN, _OMITTED = ["AUTOMOBILE", "FURNITURE", "n2", "n4"], ["BUILDING", "n4"]
_KEPT_SQL = f"{_HOLDS_SQL}, k as (select path, holds, len(list_filter(holds, lambda x: x not in ('BUILDING', 'n4') and x in {tuple(_PLAN)})) > 0 kept from h)"


def _vocabulary(spark: SparkSession) -> DataFrame:
    return spark.sql(_VOCABULARY)


def _holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_HOLDS)


@query(f"with v as ({_VOCABULARY}) select place, language from v where language in (select c_mktsegment from customer) and language <> 'BUILDING'")
def languages_in_scope(spark, sf_dir):
    census = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("language"))
    return planning.languages_in_scope(_vocabulary(spark), [], census, ["BUILDING"])


@query(f"with {_KEPT_SQL} select path, kept, case when kept then array_to_string(list_filter(holds, lambda x: x in {tuple(_PLAN)}), ',') end loaded from k")
def consumer_retention(spark, sf_dir):
    return planning.retained(_holding(spark, sf_dir), _PLAN, _OMITTED).select("path", "kept", F.array_join("loaded", ",").alias("loaded"))


@query(f"with {_KEPT_SQL}, s as (select s_suppkey source, unnest([case when s_nationkey % 3 = 0 then 'BUILDING' else 'n4' end, 'n' || (s_nationkey % 9)]) l from supplier) select distinct source, path from s join (select path, unnest(holds) l from k where not kept) using (l)")
def dropped_with(spark, sf_dir):
    left_out = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as source", "array(case when s_nationkey % 3 = 0 then 'BUILDING' else 'n4' end, 'n' || (s_nationkey % 9)) as languages")
    return planning.dropped_with(planning.retained(_holding(spark, sf_dir), _PLAN, _OMITTED), left_out)


@query(f"""with v as ({_VOCABULARY}) select s_suppkey as place, s_name as name, 'n' || (s_nationkey % 9) as language, false as in_process from supplier
union all select -1, analyzer, language, true from v where in_process and language in (select c_mktsegment from customer)""")
def providers_with_readers(spark, sf_dir):
    providers = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as place", "s_name as name", "array('n' || (s_nationkey % 9)) as languages")
    languages = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("language")).distinct()
    found = planning.with_readers(providers, _vocabulary(spark), languages)
    return found.select("place", "name", F.col("languages")[0].alias("language"), "in_process")


@query(f"with v as ({_VOCABULARY}) select distinct c_mktsegment as language from customer where c_mktsegment not in (select language from v where in_process) and c_mktsegment not in (select case when s_nationkey % 2 = 0 then 'MACHINERY' else 'FURNITURE' end from supplier)")
def unclaimed_languages(spark, sf_dir):
    languages = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("language")).distinct()
    providers = read(spark, sf_dir, "supplier").selectExpr("array(case when s_nationkey % 2 = 0 then 'MACHINERY' else 'FURNITURE' end) as languages")
    return planning.unclaimed_languages(_vocabulary(spark), languages, providers)


@query("""with m as (select c_custkey path, case when c_nationkey % 3 = 0 then '' else c_name end id, c_nationkey % 2 = 0 is_target, c_nationkey % 4 n from customer),
f as (select o_custkey path, arg_min(o_orderpriority, o_orderkey) nm from orders where o_orderstatus = 'F' group by o_custkey)
select m.path, coalesce(nullif(id, ''), nm, case when is_target and n <> 1 then '.' end) as name from m left join f using (path)""")
def module_identities(spark, sf_dir):
    modules = read(spark, sf_dir, "customer").selectExpr("c_custkey as path", "case when c_nationkey % 3 = 0 then '' else c_name end as id", "c_nationkey % 2 = 0 as is_target", "c_nationkey % 4 as n_languages")
    found = read(spark, sf_dir, "orders").selectExpr("o_custkey as path", "o_orderkey as place", "case when o_orderstatus = 'F' then o_orderpriority end as found")
    return planning.identities(modules, found)


_CLAIMS = "select s_suppkey as input, 'L' || (s_suppkey % 9) as language, case when s_nationkey < 5 then 'library' else 'program' end as kind from supplier"


@query(f"""with c as (select distinct language, kind from ({_CLAIMS})) select case when count(distinct kind) = 1 then min(kind) when count(distinct kind) > 1 then 'mixed' end kind,
case when count(distinct kind) > 1 then string_agg(language || '=' || kind, ',' order by language, kind) end kinds from c""")
def merged_target_kind(spark, sf_dir):
    read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return planning.merged_kind(spark.sql(_CLAIMS).select("language", "kind"))


@query(f"with c as ({_CLAIMS}) select language, count(distinct kind) kinds from c group by language having count(distinct kind) > 1")
def kind_clashes(spark, sf_dir):
    read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return envelope.kind_clashes(spark.sql(_CLAIMS))


@query(f"""with v as ({_VOCABULARY}), i as (select c_custkey as input, c_nationkey % 2 = 0 mixed, unnest([c_mktsegment, 'FURNITURE']) l from customer), w as (select distinct input, l from i where mixed and l in (select language from v where takes_kind)),
k as (select c_custkey as input, unnest([c_mktsegment, case when c_nationkey % 4 = 0 then 'FURNITURE' else 'HOUSEHOLD' end]) l, unnest(['library', case when c_nationkey % 3 = 0 then 'library' else 'program' end]) kind from customer where c_nationkey % 2 = 0)
select input from k where (input, l) not in (select input, l from w) union select input from w where (input, l) not in (select input, l from k) union select input from k group by input having count(distinct kind) < 2""")
def mixed_not_covering(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    inputs = customers.selectExpr("c_custkey as input", "case when c_nationkey % 2 = 0 then 'mixed' end as target_kind", "array(c_mktsegment, 'FURNITURE') as languages")
    kinds = customers.where("c_nationkey % 2 = 0").selectExpr("c_custkey as input", "inline(array(struct(c_mktsegment as language, 'library' as kind), struct(case when c_nationkey % 4 = 0 then 'FURNITURE' else 'HOUSEHOLD' end as language, case when c_nationkey % 3 = 0 then 'library' else 'program' end as kind)))")
    return planning.mixed_not_covering(inputs, kinds, _vocabulary(spark))


@query("""select s_suppkey as place from supplier where s_suppkey % 7 <> 0 and (case when s_nationkey % 3 = 0 then null else s_name end is distinct from case when s_nationkey % 5 = 0 then null else s_name end or (s_suppkey % 2 = 0 and s_nationkey % 4 = 1))""")
def runs_again(spark, sf_dir):
    base = read(spark, sf_dir, "supplier")
    before = base.selectExpr("s_suppkey as place", "case when s_nationkey % 3 = 0 then null else s_name end as scope", "s_suppkey % 7 = 0 as omitted", "s_suppkey % 2 = 0 as in_process", "array('a', 'b') as analyzed")
    after = base.selectExpr("s_suppkey as place", "case when s_nationkey % 5 = 0 then null else s_name end as scope", "case when s_nationkey % 4 = 1 then array('a') else array('a', 'b') end as analyzed")
    return planning.runs_again(before, after)


@query("with s as (select 'n' || (s_nationkey % 9) || '/' || (s_suppkey % 4) l, s_suppkey % 3 = 0 omitted from supplier) select distinct l as language from s where omitted and l not in (select l from s where not omitted)")
def left_out_languages(spark, sf_dir):
    return planning.left_out(read(spark, sf_dir, "supplier").selectExpr("array('n' || (s_nationkey % 9) || '/' || (s_suppkey % 4)) as languages", "s_suppkey % 3 = 0 as omitted"))


@query("select name, ord, cast(row_number() over (order by name, ord) as integer) place from analyzers", "analyzers")
def analyzers_by_name(spark, sf_dir):
    return planning.by_name(derive(spark, sf_dir, "analyzers").select("name", "ord"))


# the envelope

@query("select ord, cast(row_number() over (order by name, version, conformance, omitted, target_root, ord) as integer) place from analyzers", "analyzers")
def input_order(spark, sf_dir):
    inputs = derive(spark, sf_dir, "analyzers").withColumn("target_identity", F.col("ord"))
    return envelope.ordered_inputs(inputs).select("ord", "place")


@query("select distinct path, code from (select path, code from findings where analyzer = 'an0' union all select path, code from findings where analyzer = 'an1')", "findings")
def record_union(spark, sf_dir):
    notes = derive(spark, sf_dir, "findings").select("analyzer", "path", "code")
    return envelope.record_union([notes.where(F.col("analyzer") == f"an{i}").drop("analyzer") for i in range(2)])


@query("select cast(sum(s_suppkey) as bigint) in_effect, cast(sum(s_nationkey) as bigint) reasons, cast(sum(s_suppkey % 3) as bigint) probable, cast(sum(s_suppkey % 5) as bigint) possible from supplier")
def summed_totals(spark, sf_dir):
    return envelope.summed(read(spark, sf_dir, "supplier").selectExpr("s_suppkey as in_effect", "s_nationkey as reasons", "s_suppkey % 3 as probable", "s_suppkey % 5 as possible"))


@query("""with p as (select 0 kind, cast(l_orderkey as bigint) ord, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as ref from lineitem where l_returnflag = 'N'
 union all select 1, cast(o_orderkey as bigint), 'check' || o_orderkey from orders where o_orderstatus = 'F')
select ref, 'schema/c-' || row_number() over (order by kind, ord, ref) as id from p""")
def minted_ids(spark, sf_dir):
    """Records that nothing holds, numbered in order, and checks behind them."""
    records = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as ord", "l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as ref", "case when l_returnflag <> 'N' then 'held' end as held")
    checks = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as ord", "'check' || o_orderkey as ref")
    return envelope.minted(records, checks, "schema")


@query("select ref, analyzer, line, row_number() over (order by path, line, col, code, ref, analyzer, component, end_line, deletable) as number from findings", "findings")
def numbered_findings(spark, sf_dir):
    """Canonical order over all findings, in ranges."""
    order = ["path", "line", "col", "code", "ref", "analyzer", "component", "end_line", "deletable"]
    return envelope.numbered(derive(spark, sf_dir, "findings"), order).select("ref", "analyzer", "line", "number")


_ENTRIES = """select 'c' || (o_orderkey % 3001) as id, o_custkey % 5 as input, case o_orderkey % 4 when 0 then 'configurations' when 1 then 'configurations_not_built' when 2 then 'consumers.loaded' else 'consumers.unavailable' end as "array",
 case when o_totalprice > 300000 then 'x' else 'y' end as members from orders"""


@query(f"""with e as ({_ENTRIES}), s as (select id, input, case "array" when 'configurations_not_built' then 'configurations' when 'consumers.unavailable' then 'consumers.loaded' else "array" end arr, "array" in ('configurations_not_built', 'consumers.unavailable') side from e)
select "array", id, 'identity' reason from e group by "array", id having count(distinct members) > 1 and count(distinct input) > 1
union all select distinct a.arr, a.id, 'state' from s a join s b on a.arr = b.arr and a.id = b.id and a.side = false and b.side = true and a.input <> b.input""")
def id_collisions(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return envelope.id_collisions(spark.sql(_ENTRIES.replace('"array"', "`array`")))


@query("""with f as (select s_suppkey as input, s_suppkey % 4 <> 0 name_ok, s_suppkey % 5 <> 0 lang_ok, 'c' || (s_suppkey % 60) comp, 'r' || s_nationkey ref from supplier),
n as (select c_custkey % 100 as input, 'c' || (c_custkey % 7) v from customer union select c_custkey % 100, 'r' || c_nationkey from customer)
select input, case when not name_ok then 'analyzer' when not lang_ok then 'language' else 'finding' end reason from f
where not name_ok or not lang_ok or exists (select 1 from n where n.input = f.input and n.v in (f.comp, f.ref))""")
def fact_refusals(spark, sf_dir):
    facts = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as input", "case when s_suppkey % 4 <> 0 then s_name else 'x' end as name", "'1' as version", "case when s_suppkey % 5 <> 0 then 'go' else 'ts' end as language", "array('c' || (s_suppkey % 60)) as components", "array('r' || s_nationkey) as refs")
    inputs = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as input", "s_name as name", "'1' as version", "array('go', 'proto') as languages")
    findings = read(spark, sf_dir, "customer").selectExpr("c_custkey % 100 as input", "'c' || (c_custkey % 7) as component", "'r' || c_nationkey as ref")
    return envelope.fact_refusals(facts, inputs, findings)


@query("select 'no input' as refused where (select count(*) from supplier where s_acctbal > 1e12) = 0")
def no_inputs(spark, sf_dir):
    """Refused, as no report is as large."""
    return envelope.no_inputs(read(spark, sf_dir, "supplier").where("s_acctbal > 1e12"))


@query("""/*with*/ d as (select component, 1 as symbols, 2 as lines from findings where class_rank = 2 group by component)
select component, cast(n - coalesce(symbols, 0) as bigint) as symbols, cast(dl - coalesce(lines, 0) as bigint) as deletable from (select component, count(*) n, sum(deletable) dl from findings group by component) left join d using (component)""", "findings")
def debited_counts(spark, sf_dir):
    found = derive(spark, sf_dir, "findings")
    counts = found.groupBy("component").agg(F.count("*").alias("symbols"), F.sum("deletable").alias("deletable"))
    return envelope.debited(counts, found.where("class_rank = 2").select("component").distinct().selectExpr("component", "1 as symbols", "2 as lines"))


@query("""/*with*/ r as (select idx, role, state, component, class_rank, 'go://' || idx as ref from records)
select idx, ref, component, class_rank + 1 as class_rank, false carried from r where role = 'schema' and state = 'dead' union all select idx, ref, component, class_rank, false from r where role = 'implementer' and state = 'dead'
union all select idx, 'x' || (idx % 7), component, class_rank, true from r where role = 'implementer' and state = 'dead'""", "records")
def record_carriers(spark, sf_dir):
    records = derive(spark, sf_dir, "records").withColumns({"ref": F.concat(F.lit("go://"), "idx"), "carried": F.array(F.concat(F.lit("x"), F.col("idx") % 7))})
    return envelope.carriers(records, records.select("idx", (F.col("class_rank") + 1).alias("promoted_rank")))


# suppressions

_COMMENTS = "select 'f' || (l_partkey % 50) as path, cast(l_orderkey % 300 as int) as line, l_linenumber as col, l_linenumber % 2 = 0 as alone, l_returnflag || l_suppkey % 3 as code, case when l_suppkey % 5 <> 0 then 'why' end as reason from lineitem"
_DECLS = "select 'f' || (o_custkey % 50) as path, cast(o_orderkey % 300 as int) as line, 's' || o_orderkey as symbol from orders"


def _comments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("lineitem", "orders"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_COMMENTS).withColumn("codes", F.array("code")).drop("code"), spark.sql(_DECLS)


@query(f"with c as ({_COMMENTS}), d as ({_DECLS}) select c.code, d.symbol, count(*) n from c left join d on d.path = c.path and d.line = c.line + cast(alone as int) where reason is not null group by all")
def directive_records(spark, sf_dir):
    records, _ = suppression.directives(*_comments(spark, sf_dir))
    return records.groupBy("code", "symbol").agg(F.count("*").alias("n"))


@query(f"""with c as ({_COMMENTS}) select case when col % 2 = 0 then path || ':file' else path end as ref, path, greatest(line, 1) line, col, 'comment for ' || code || ' carries no reason' message from c where reason is null""")
def suppression_checks(spark, sf_dir):
    _, refused = suppression.directives(*_comments(spark, sf_dir))
    odd = refused.withColumn("symbol", F.when(F.col("col") % 2 == 1, F.col("path")))
    files = refused.select("path", F.concat("path", F.lit(":file")).alias("file_ref")).distinct()
    return suppression.self_checks(odd, "comment", files)


_SITES = "select code, ref as symbol, path, line, col from findings where analyzer = 'an0'"
_SUPPRESSED = """/*with*/ d as (select ref, path, code, case when root = 1 then 'exempt' end held, case when code like 'DS2%' then 'severity' when class_rank > 1 then 'confidence' end withheld_by, class_rank from findings),
w as (select ref as symbol, path, code from d where held is null and withheld_by is null),
rec as (select code, ref as symbol, path, line, col from findings where analyzer = 'an0'), unclean as (select path from findings group by path having count(*) % 2 = 0)"""


def _suppressed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = derive(spark, sf_dir, "findings")
    levels = spark.createDataFrame([("DS2001", 0), ("DS2002", 0), ("DS1001", 2)], "code string, level int")
    declared = suppression.dialed(found.select("ref", "path", "code", "class_rank", F.when(F.col("root") == 1, "exempt").alias("held")), levels, 1)
    records = found.where("analyzer = 'an0'").select("code", F.col("ref").alias("symbol"), "path", "line", "col")
    return declared, records, found.groupBy("path").agg(F.count("*").alias("n")).where("n % 2 = 0").select("path")


@query(f"{_SUPPRESSED} select distinct symbol as ref, 'suppressed' reason from w where (symbol, path, code) in (select symbol, path, code from rec)", "findings")
def suppressed_declarations(spark, sf_dir):
    return suppression.decided(*_suppressed(spark, sf_dir))[0]


@query(f"""{_SUPPRESSED} select path, line, col, arg_min(code, code || symbol) code, arg_min(symbol, code || symbol) symbol, string_agg(distinct code, ',' order by code) codes from rec
where (symbol, path, code) not in (select symbol, path, code from w) and path not in (select path from unclean) group by path, line, col""", "findings")
def stale_sites(spark, sf_dir):
    """Suppressions that hold nothing, one row a site, but in files not read cleanly."""
    return suppression.stale_sites(suppression.decided(*_suppressed(spark, sf_dir))[1]).withColumn("codes", F.array_join("codes", ","))


@query(f"""{_SUPPRESSED} select coalesce(held, case withheld_by when 'severity' then 'severity-allow' when 'confidence' then 'withheld' end, 'reported') reason, class_rank, count(*) n from d group by all""", "findings")
def withheld_reasons(spark, sf_dir):
    declared, _, _ = _suppressed(spark, sf_dir)
    held = suppression.withheld(declared, declared.select("path").where("false"))
    return held.groupBy(F.coalesce("held", F.lit("reported")).alias("reason"), "class_rank").agg(F.count("*").alias("n"))


@query(f"{_SUPPRESSED} select class_rank, count(*) n from d where held is null and withheld_by = 'confidence' group by class_rank", "findings")
def withheld_by_class(spark, sf_dir):
    declared, _, _ = _suppressed(spark, sf_dir)
    return suppression.withheld_by_class(suppression.withheld(declared, declared.select("path").where("false")))


_ROOTS = ["s1*/?", "s?2/*", "go://s1*", "proto://s9*", "s7/1", "*x", "pro*://s3/*"]


@query("""/*with*/ r as (select distinct ref from findings) select ref from r where regexp_matches(ref, '^s1.*/.$') or regexp_matches(ref, '^s.2/.*$') or ref = 's7/1'""", "findings")
def root_globs(spark, sf_dir):
    refs = derive(spark, sf_dir, "findings").select("ref")
    return suppression.rooted(refs, spark.createDataFrame([(r,) for r in _ROOTS], "entry string"), refs.where("false"))[0]


@query("select * from (values ('proto://s9*'), ('*x'), ('pro*://s3/*')) t(entry) where (select count(*) from findings) > 0", "findings")
def unmatched_globs(spark, sf_dir):
    refs = derive(spark, sf_dir, "findings").select("ref")
    return suppression.rooted(refs, spark.createDataFrame([(r,) for r in _ROOTS], "entry string"), refs.where("false"))[1]


# generation and import roots

_GEN = """select distinct regexp_replace(path, '/[^/]*$', '') as dir, case when length(path) % 3 = 0 then 'go' when length(path) % 3 = 1 then 'gateway' else 'ts' end as plugin, length(path) % 5 = 0 as unknown from files where path like '%/%/%'"""


@query(f"""/*with*/ c as ({_GEN}), f as (select distinct path from files), m as (select f.path, c.plugin, c.unknown from f join c on starts_with(f.path, c.dir || '/'))
select f.path, coalesce(bool_or(plugin = 'gateway'), false) http, coalesce(bool_or(unknown or plugin <> 'go'), true) as unknown from f left join m using (path) group by f.path""", "files")
def generation_coverage(spark, sf_dir):
    files = derive(spark, sf_dir, "files")
    files.createOrReplaceTempView("files")
    configs = spark.sql(_GEN).groupBy("dir").agg(F.collect_set("plugin").alias("plugins"), F.max("unknown").alias("unknown"))
    generators = spark.createDataFrame([("go", "go"), ("ts", "ts"), ("gateway", "go2")], "plugin string, language string")
    return generation.coverage(files.select("path"), configs, generators, ["gateway"], ["go"])


_IMPORT_ROOTS = "select dir, row_number() over (order by length(dir) % 7, dir) as rank from (select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as dir from files where path like '%/%/%' union select distinct split_part(path, '/', 1) from files where path like '%0') r"
_PLACED = f"""/*with*/ roots as ({_IMPORT_ROOTS}), f as (select distinct path from files),
m as (select path, rank, substr(path, length(dir) + 2) below from f join roots on starts_with(path, dir || '/')),
p as (select f.path, coalesce(arg_min(below, rank), f.path) import_path, count(rank) > 0 held from f left join m using (path) group by f.path),
w as (select below import_path, arg_min(path, rank) winner from m group by below)"""


def _import_roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = derive(spark, sf_dir, "files").select("path")
    files.createOrReplaceTempView("files")
    return files, spark.sql(_IMPORT_ROOTS)


@query(f"{_PLACED} select path, import_path, held from p", "files")
def import_paths(spark, sf_dir):
    return generation.import_paths(*_import_roots(spark, sf_dir))


@query(f"""{_PLACED} select path, case when winner <> path and held then winner || ' under an earlier import root' when winner <> path then winner || ' under an import root'
 else import_path || ' in the compiler''s own include directory' end as "read" from p left join w using (import_path) where winner <> path or (not held and right(path, 1) = '5')""", "files")
def shadowed_files(spark, sf_dir):
    files, roots = _import_roots(spark, sf_dir)
    return generation.shadowed(files, roots, files.where("path like '%5'").select(F.col("path").alias("import_path")))


@query("select c_name || '/x' as entry, 'other' as plugin from customer union all select 'buf.build/o/' || s_name || '@v1', case when s_suppkey % 2 = 0 then 'protoc-gen-go' else 'other' end from supplier where false union all select distinct p_brand || '/protoc-gen-go@' || p_size, 'protoc-gen-go' from part union all select distinct p_brand || '/connect_es', 'connect-es' from part")
def plugin_names(spark, sf_dir):
    entries = read(spark, sf_dir, "customer").selectExpr("c_name || '/x' as entry").union(read(spark, sf_dir, "part").selectExpr("p_brand || '/protoc-gen-go@' || p_size").distinct()).union(read(spark, sf_dir, "part").selectExpr("p_brand || '/connect_es'").distinct())
    return entries.select("entry", generation.plugin_name(F.col("entry"), ["protoc-gen-go", "connect-es"]).alias("plugin"))


@query("""with l as (select 'f' || (l_suppkey % 9) as file, 'p' || l_orderkey as path, l_linenumber * 1000000 + l_partkey * 100 + l_quantity as ord, l_linenumber as line from lineitem)
select file, path, arg_min(line, ord) as line from l group by file, path""")
def first_locations(spark, sf_dir):
    return generation.first_locations(read(spark, sf_dir, "lineitem").selectExpr("'f' || (l_suppkey % 9) as file", "'p' || l_orderkey as path", "l_linenumber * 1000000 + l_partkey * 100 + l_quantity as ord", "l_linenumber as line"))


# configuration and sources

@query("""/*with*/ m as (select 's' || (source_rank % 2) section, key as name, value, source, source_rank, seq from settings where value is not null),
one as (select section, name, source_rank, source, max(value) as value from m group by section, name, source_rank, source)
select section, name, arg_min(value, source_rank) as value, arg_min(source, source_rank) as source from (select section, name, min(source_rank) source_rank, arg_min(source, source) source, arg_min(value, source) as value from one group by section, name, source_rank) group by section, name""", "settings")
def keyed_sections(spark, sf_dir):
    stated = derive(spark, sf_dir, "settings").where("value is not null").selectExpr("'s' || (source_rank % 2) as section", "key as name", "value", "source", "source_rank")
    one = stated.groupBy("section", "name", "source_rank", "source").agg(F.max("value").alias("value"))
    first = one.groupBy("section", "name", "source_rank").agg(F.min_by("value", "source").alias("value"), F.min("source").alias("source"))
    return settings.keyed(first)


_STATED = """select 'k' || (s_suppkey % 6) as key, case s_suppkey % 7 when 0 then '12' when 1 then '1.0' when 2 then '1e3' when 3 then '"x"' when 4 then 'true' when 5 then '-0' else '[1]' end as value, 'r' || s_suppkey as source from supplier"""


@query(f"""with s as ({_STATED}), k(key, type) as (values ('k0', 'integer'), ('k1', 'string'), ('k2', 'boolean'), ('k3', 'integer'), ('k4', 'array')),
r as (select s.*, type, case when value = '"x"' then 'string' when value = 'true' then 'boolean' when value = '[1]' then 'array' else 'integer' end kind from s left join k using (key))
select key, source, case when type is null then 'not a key' when type = 'integer' and value in ('1.0', '1e3') then 'not a whole number' when type <> kind then 'another type' end reason from r
where type is null or (type = 'integer' and value in ('1.0', '1e3')) or type <> kind""")
def refused_settings(spark, sf_dir):
    read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    keys = spark.createDataFrame([("k0", "integer"), ("k1", "string"), ("k2", "boolean"), ("k3", "integer"), ("k4", "array")], "key string, type string")
    return settings.refused_values(spark.sql(_STATED), keys)


@query("with p as (select s_nationkey source, s_suppkey place, 'tool' || (s_suppkey % 3) as name from supplier) select source, place, name from p where exists (select 1 from p q where q.source = p.source and q.name = p.name and q.place < p.place)")
def repeated_providers(spark, sf_dir):
    return settings.repeated_providers(read(spark, sf_dir, "supplier").selectExpr("s_nationkey as source", "s_suppkey as place", "'tool' || (s_suppkey % 3) as name"))


@query("""/*with*/ r as (select *, row_number() over (partition by key order by source_rank, seq) k from settings where value is not null), b as (select key, value, source from r where k = 1)
select 'k' || c_custkey as key, coalesce(value, c_nationkey) as value, coalesce(source, 'default') as source from customer left join b on b.key = 'k' || c_custkey""", "settings")
def settings_with_defaults(spark, sf_dir):
    keys = read(spark, sf_dir, "customer").selectExpr("'k' || c_custkey as key", "c_nationkey as default")
    return settings.with_defaults(settings.resolve(derive(spark, sf_dir, "settings")), keys)


@query("""/*with*/ r as (select *, row_number() over (partition by key order by source_rank, seq) k from settings where value is not null)
select key, value from r where k = 1 and key in (select 'k' || c_custkey from customer where c_mktsegment in ('BUILDING', 'FURNITURE'))""", "settings")
def delivered_settings(spark, sf_dir):
    routing = read(spark, sf_dir, "customer").selectExpr("'k' || c_custkey as key", "c_mktsegment as language")
    return settings.delivered(settings.resolve(derive(spark, sf_dir, "settings")), routing, ["BUILDING", "FURNITURE"])


@query("""select s_name as name, case when s_suppkey % 6 not in (0, 1, 4) then 'exit code' when s_nationkey % 5 = 0 then 'no report' when s_nationkey % 7 = 0 then 'name' else 'merged' end reason
from supplier where s_suppkey % 6 not in (0, 1, 4) or s_nationkey % 5 = 0 or s_nationkey % 7 = 0 or s_nationkey % 4 = 1""")
def untrusted_reports(spark, sf_dir):
    runs = read(spark, sf_dir, "supplier").selectExpr("s_name as name", "s_suppkey % 6 as exit", "case when s_nationkey % 5 = 0 then null when s_nationkey % 7 = 0 then 'x' else s_name end as reported", "case when s_nationkey % 4 = 1 then array('a') end as merged_from")
    return documents.untrusted(runs)


@query("""select 'a' || (o_custkey % 3) as analyzer, cast(0 as int) as place, 'go://' || o_orderkey as ref, 'c-' || o_custkey as component, 'x' || o_orderkey as carried from orders""")
def facts_scan(spark, sf_dir):
    """Binding records of facts documents in JSON."""
    doc = F.expr("""to_json(named_struct('analyzer', named_struct('name', 'a' || (o_custkey % 3), 'version', '1'), 'language', 'go', 'bindings', array(named_struct('role', 'implementer', 'finding',
        named_struct('symbol', named_struct('ref', 'go://' || o_orderkey), 'component', named_struct('id', 'c-' || o_custkey)), 'carried', array(named_struct('symbol', named_struct('ref', 'x' || o_orderkey)))))))""")
    found = documents.facts(read(spark, sf_dir, "orders").select(F.lit("p").alias("path"), doc.alias("content")))
    return found.select("analyzer", "place", "ref", "component", F.col("carried_refs")[0].alias("carried"))


# text

@query("""with n as (select distinct p_name n from part), x as (select n, replace(n, ' ', '_') s from n)
select n, case when not regexp_matches(s, '^[A-Za-z0-9]+$') then 'should be TitleCase' when not regexp_matches(s, '^[A-Z]') then 'should begin with a capital letter' end title,
case when not regexp_matches(s, '^[a-z0-9_.]+$') then 'should be lower_snake_case' when not regexp_matches(s, '^[a-z]') then 'should begin with a lower case letter' when regexp_matches(s, '^_|_$|__|_[^A-Za-z]') then 'contains style violating underscores' end lower_snake,
case when not regexp_matches(upper(s), '^[A-Z0-9_]+$') then 'should be UPPER_SNAKE_CASE' when not regexp_matches(upper(s), '^[A-Z]') then 'should begin with an upper case letter' when regexp_matches(upper(s), '^_|_$|__|_[^A-Za-z]') then 'contains style violating underscores' end upper_snake from x""")
def naming_styles(spark, sf_dir):
    s = F.replace("n", F.lit(" "), F.lit("_"))
    n = read(spark, sf_dir, "part").select(F.col("p_name").alias("n")).distinct()
    return n.select("n", names.title_style(s).alias("title"), names.lower_snake_style(s).alias("lower_snake"), names.upper_snake_style(F.upper(s)).alias("upper_snake"))


@query("""with g as (select c_nationkey k, list_sort(list(distinct c_mktsegment)) l, count(*) n from customer group by c_nationkey)
select k, case when len(l) < 2 then l[1] else array_to_string(l[1:len(l) - 1], ', ') || ' or ' || l[len(l)] end listed, n || case when n = 1 then ' customer' else ' customers' end counted, '"' || array_to_string(l, '", "') || '"' quoted,
case when k % 3 = 0 then '1.' || k else 'devel' end as version from g""")
def text_lists(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("l"), F.count("*").alias("n"))
    stamped = g.withColumn("stamped", F.expr("case k % 3 when 0 then 'v1.' || k when 1 then '(devel)' else 'v' end"))
    return stamped.select("k", names.or_list(F.col("l")).alias("listed"), names.counted(F.col("n"), "customer", "customers").alias("counted"), names.quoted(F.col("l")).alias("quoted"), names.version_of("stamped").alias("version"))


@query("select page_id, array_to_string(list_transform(['x: a', 'tool: b', 'c' || page_id], lambda x: case when starts_with(x, 'tool: ') then x else 'tool: ' || x end), '|') said from pages")
def relayed_lines(spark, sf_dir):
    printed = F.concat(F.lit("x: a\r\ntool: b\rc"), "page_id", F.lit("\n"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(names.quoted_lines(printed, F.lit("tool")), "|").alias("said"))


# outcomes

@query("select s_name as name, s_suppkey % 4 = 3 and s_suppkey % 3 <> 0 as setup_failed, s_suppkey % 4 = 3 and s_suppkey % 3 = 1 as no_program from supplier")
def outcome_kinds(spark, sf_dir):
    failures = "case s_suppkey % 3 when 0 then array(struct('read' as class, false as setup)) when 1 then array(struct('no-program' as class, true as setup)) else array(struct('no-program' as class, true as setup), struct('missing' as class, true as setup)) end as failures"
    return outcomes.kinds(read(spark, sf_dir, "supplier").selectExpr("s_name as name", "s_suppkey % 4 as exit", failures)).select("name", "setup_failed", "no_program")


@query("select o_custkey as run, case when bool_and(o_orderstatus <> 'O') then 2 else 3 end as exit from orders group by o_custkey")
def exit_codes(spark, sf_dir):
    """2 only where every joined error is a refusal."""
    return outcomes.exit_code(read(spark, sf_dir, "orders").selectExpr("o_custkey as run", "o_orderstatus <> 'O' as refusal"))


_RUNS = """select s_suppkey as ord, s_name as name, 'n' || (s_nationkey % 5) as language, s_suppkey % 4 = 1 as setup_failed, s_suppkey % 4 = 2 as omitted, s_suppkey % 8 = 2 as leaves from supplier"""


@query(f"""with r as ({_RUNS}), g as (select * from r where not setup_failed and not omitted), names as (select string_agg(name, ' and ' order by name) names from g),
rest as (select f.ord, string_agg(distinct '"' || g.language || '"', ', ' order by '"' || g.language || '"') rest from r f join g on g.language <> f.language where f.setup_failed group by f.ord)
select cast(place as integer) place, name, case when setup_failed then 'tool: to analyze the target without ' || name || ', ' || case when rest is null then 'run ' || names || ' alone' else 'set analysis.languages: [' || rest || '] or run ' || names || ' alone' end
 else 'tool: ' || name || ' found no program, so the run ' || case when leaves then 'leaves "' || language || '" out of scope, and with it the consumer c' || ord else 'goes on without it' end end as line
from (select r.*, row_number() over (order by name, ord) place from r) p left join rest using (ord), names where setup_failed or omitted""")
def outcome_lines(spark, sf_dir):
    read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    none = "array()"
    runs = spark.sql(_RUNS).selectExpr("ord", "name", "array(language) as languages", "setup_failed", "omitted", f"case when leaves then array(language) else {none} end as left_out", f"case when leaves then array('c' || ord) else {none} end as dropped")
    return outcomes.lines(runs, "tool")


_SUBJECTS = [("DS1001", "symbols", "delete it", ["a comment", "a row"]), ("DS2001", "edges", "cut it", []), ("DS3001", "roots", "name it", ["a comment", "a row", "a file"]), ("DS2002", "x", "y", ["z"])]


@query("""/*with*/ v(place, code, line) as (values (1, 'DS1001', 'remediation: for each failing finding about symbols: delete it; or record an adjudication with its reason in a comment or a row'),
(2, 'DS2001', 'remediation: for each failing finding about edges: cut it; no suppression can name edges'), (3, 'DS2002', 'remediation: for each failing finding about x: y; or record an adjudication with its reason in z'),
(5, 'DS3001', 'remediation: for each failing finding about roots: name it; or record an adjudication with its reason in a comment, a row or a file')) select place, line from v where code in (select code from findings where severity_rank >= 2)""", "findings")
def remediation_lines(spark, sf_dir):
    vocabulary = spark.createDataFrame([(0, "DS3002"), (1, "DS1001"), (2, "DS2001"), (3, "DS2002"), (4, "DS9001"), (5, "DS3001")], "place int, code string")
    failing = accounting.failing_subjects(derive(spark, sf_dir, "findings"), 2, vocabulary)
    return outcomes.remediation(failing, spark.createDataFrame(_SUBJECTS, "code string, names string, remedy string, places array<string>"))


@query("""/*with*/ d as (select distinct src as ref, case when src % 7 = 0 then 'message' when src % 5 = 0 then 'enum' when src % 3 = 0 then 'field' else 'extension' end kind from links),
arcs as (select src, dst from links where seed and dst in (select ref from d) union select src, dst from links join d a on a.ref = src join d b on b.ref = dst where not seed and a.kind in ('message', 'enum') and b.kind in ('field', 'value')),
r as (select ref from d where kind = 'extension' and ref % 11 = 0 union select a.dst from r join arcs a on a.src = r.ref) select ref from r""", "links", recursive=True)
def option_reached(spark, sf_dir):
    links = derive(spark, sf_dir, "links")
    declared = links.select(F.col("src").alias("ref")).distinct().selectExpr("ref", "case when ref % 7 = 0 then 'message' when ref % 5 = 0 then 'enum' when ref % 3 = 0 then 'field' else 'extension' end as kind")
    return schema_rules.option_reached(declared.where("kind = 'extension' and ref % 11 = 0"), declared, links.where("seed"), links.where("not seed"))


@query("""select 'roots.json' as path, 1 as line, 1 as col, n as ref, case when n like '%0' then 'configured root pattern' else 'configured root' end || ' matches no symbol of the inventory' as message
from (select s_name || case when s_suppkey % 10 = 0 then '*0' else 'x' end n from supplier)""")
def root_findings(spark, sf_dir):
    return schema_rules.root_findings(read(spark, sf_dir, "supplier").selectExpr("s_name || case when s_suppkey % 10 = 0 then '*0' else 'x' end as entry"), "roots.json")


@query("""select 'k' || c_custkey as key, c_mktsegment as value, 'flags' as source from customer where c_nationkey % 2 = 0 union all select 'k' || c_custkey, c_name, 'repository' from customer where c_nationkey % 2 = 1""")
def assembled_settings(spark, sf_dir):
    """Flags before the repository's document."""
    customers = read(spark, sf_dir, "customer")
    flags, stated = customers.where("c_nationkey % 2 = 0").selectExpr("'k' || c_custkey as key", "c_mktsegment as value"), customers.selectExpr("'k' || c_custkey as key", "c_name as value")
    every, _ = settings.assembled([("flags", flags), ("repository", stated)], stated.select("key", F.lit("string").alias("type")))
    return settings.resolve(every)


@query("""/*with*/ n as (select distinct code as kind, path, case when root = 1 then component end as key, 'm' || line as message from findings)
select kind, path, key, message, row_number() over (order by kind, path, key nulls first, message) as place from n""", "findings")
def ordered_notes(spark, sf_dir):
    notes = derive(spark, sf_dir, "findings").selectExpr("code as kind", "path", "case when root = 1 then component end as key", "'m' || line as message").distinct()
    return envelope.ordered_notes(notes)


@query("select 'program' as target_kind, cast(0 as bigint) n_findings, cast(0 as bigint) deletable_lines, cast(0 as bigint) listed")
def empty_merge(spark, sf_dir):
    found = envelope.empty_merge(spark, "program")
    return found.select("target_kind", "n_findings", "deletable_lines", (F.size("findings") + F.size("notes")).cast("bigint").alias("listed"))


# schema files and YAML

_PROTO = """'syntax = "proto3"; package p' || (l_partkey % 30) || '; // n' || chr(10) || 'message M' || l_orderkey || ' { repeated int32 f_' || l_suppkey || ' = ' || l_linenumber || ' [json_name = "j' || l_suppkey || '"]; reserved ' || (l_linenumber + 1) || ' to 90; }'"""


@query("""select l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_partkey as file, 'proto://p' || (l_partkey % 30) || '#M' || l_orderkey || '.f_' || l_suppkey as ref, 'repeated' as label, cast(l_linenumber as bigint) as number, 2 as line,
cast(length('message M' || l_orderkey || ' { ') + 1 as int) as col, 'j' || l_suppkey as json_name from lineitem""")
def schema_files_scan(spark, sf_dir):
    """Fields of schema files, one file a row."""
    docs = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_partkey as path", f"{_PROTO} as content")
    found = proto_files.declarations(proto_files.parsed(docs)).where("kind = 'field'")
    return found.select("file", "ref", "label", "number", "line", "col", F.col("options")["json_name"].alias("json_name"))


@query("""with recursive a as (select 'f' || c_custkey || '.proto' as src, 'f' || (c_custkey * 7 % 40 + 1) || '.proto' as dst from customer),
r as (select src, dst from a union select r.src, a.dst from r join a on a.src = r.dst) select src as file from r where src = dst""")
def import_cycles(spark, sf_dir):
    """Schema files whose imports lead back to them."""
    docs = read(spark, sf_dir, "customer").selectExpr("'f' || c_custkey || '.proto' as path", "'import \"f' || (c_custkey * 7 % 40 + 1) || '.proto\"; message M {}' as content")
    return proto_files.cyclic(proto_files.parsed(docs))


@query("""select 'b' || s_suppkey as path, k as key, case k when 'version' then 'v1' when 'plugins.0.name' then s_name when 'plugins.0.opt.0' then 'a: b' else cast(s_nationkey as varchar) end as value, cast(null as varchar) refusal
from supplier, (values ('version'), ('plugins.0.name'), ('plugins.0.opt.0'), ('plugins.0.opt.1')) t(k) where s_suppkey % 9 <> 0 union all select 'b' || s_suppkey, null, null, 'an anchor' from supplier where s_suppkey % 9 = 0""")
def yaml_scan(spark, sf_dir):
    """Scalars of YAML documents; a document outside the subset is a refusal."""
    text = "'version: ' || case when s_suppkey % 9 = 0 then '&x ' else '' end || 'v1' || chr(10) || 'plugins:' || chr(10) || '  - name: ' || s_name || ' # note' || chr(10) || '    opt: [\"a: b\", ' || s_nationkey || ']'"
    return yaml_subset.entries(read(spark, sf_dir, "supplier").selectExpr("'b' || s_suppkey as path", f"{text} as content"))
