"""All registered queries of the merge engine: name -> callable, name -> oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names
from tributary.operators import accounting, admission, bindings, merge, paths, ranges, routing, schema_rules, settings, suppression
from tributary.plans.graph import connected, reachable
from tributary.registry import ORACLE_SQL, QUERIES, query
from tributary.registry import read as _read
from tributary.relations import derive
from tributary.sinks import outputs
from tributary.sources import documents

__all__ = ["ORACLE_SQL", "QUERIES"]


# the merge

@query("select analyzer, code, count(*) n, count(distinct component) components from findings group by analyzer, code", "findings")
def union_stamp(spark, sf_dir):
    """Three reports, stamped with their analyzer and put together as a multiset."""
    found = derive(spark, sf_dir, "findings")
    reports = [merge.stamp(found.where(F.col("analyzer") == f"an{i}").drop("analyzer"), f"an{i}") for i in range(3)]
    return merge.union_reports(reports).groupBy("analyzer", "code").agg(F.count("*").alias("n"), F.count_distinct("component").alias("components"))


@query("select path, ref, cast(row_number() over (partition by path order by path, line, col, code, ref, analyzer) as integer) place from findings", "findings")
def canonical_order(spark, sf_dir):
    return merge.canonical_rank(derive(spark, sf_dir, "findings"), ("path",)).select("path", "ref", "place")


@query("""/*with*/ r as (select *, row_number() over (partition by component order by path, line, col, code, ref, analyzer) k from findings)
select component, ref, path, line from r where k = 1""", "findings")
def first_per_id(spark, sf_dir):
    return merge.first_per(derive(spark, sf_dir, "findings"), ["component"], list(merge.CANONICAL)).select("component", "ref", "path", "line")


@query("""select a.edge, a.side, count(*) pairs from evaluations a join evaluations b on a.edge = b.edge and a.side <> b.side
group by a.edge, a.side""", "evaluations")
def edge_pairing(spark, sf_dir):
    """Evaluations against those of the edge's other sides, counted without making the pairs."""
    sides = derive(spark, sf_dir, "evaluations").groupBy("edge", "side").agg(F.count("*").alias("k"))
    other = sides.select(F.col("edge").alias("e"), F.col("side").alias("s"), F.col("k").alias("m"))
    met = sides.join(other, (F.col("edge") == F.col("e")) & (F.col("side") != F.col("s")))
    return met.groupBy("edge", "side").agg(F.sum(F.col("k") * F.col("m")).alias("pairs"))


@query("""select edge, side, min(case state when 'live' then 0 when 'dead' then 1 else 2 end) state_rank from evaluations group by edge, side""", "evaluations")
def strongest_state(spark, sf_dir):
    return merge.strongest_states(derive(spark, sf_dir, "evaluations"))


@query("""/*with*/ s as (select edge, side, min(case state when 'live' then 0 when 'dead' then 1 else 2 end) r from evaluations group by edge, side),
f as (select edge, min(side) side from s where r = 2 group by edge)
select edge, side, cast(row_number() over (order by edge) as integer) number from f""", "evaluations")
def stale_edges(spark, sf_dir):
    return merge.stale_edges(derive(spark, sf_dir, "evaluations"))


@query("""select edge, symbol from evaluations e where state = 'dead' and not exists (select 1 from evaluations o where o.edge = e.edge and o.side <> e.side)""", "evaluations")
def unresolved_evaluations(spark, sf_dir):
    return merge.unresolved(derive(spark, sf_dir, "evaluations")).select("edge", "symbol")


_DROPPED = """/*with*/ dead as (select * from evaluations where state = 'dead'),
seeds as (select d.component from dead d where exists (select 1 from evaluations o where o.edge = d.edge and o.side <> d.side)
  and (exists (select 1 from evaluations o where o.edge = d.edge and o.side <> d.side and o.state = 'live')
       or not exists (select 1 from evaluations o where o.edge = d.edge and o.side <> d.side and o.state = 'dead'))),
arcs as (select distinct o.component src, d.component dst from dead d join dead o on o.edge = d.edge and o.side <> d.side),
dropped as (select component from seeds union select a.dst from dropped p join arcs a on a.src = p.component)"""
_PROMOTED = _DROPPED + """,
kept as (select * from dead d where exists (select 1 from evaluations o where o.edge = d.edge and o.side <> d.side)
  and component not in (select component from dropped))"""


@query(f"{_DROPPED} select component from dropped", "evaluations", recursive=True)
def fixpoint_dropped(spark, sf_dir):
    return merge.dropped_components(derive(spark, sf_dir, "evaluations"))


@query(f"{_PROMOTED} select analyzer, edge, side, symbol, component from kept", "evaluations", recursive=True)
def promoted(spark, sf_dir):
    return merge.promoted(derive(spark, sf_dir, "evaluations")).select("analyzer", "edge", "side", "symbol", "component")


@query(f"""{_PROMOTED} select ref, component, count(distinct edge || ' ' || side) carriers, min(edge || ' ' || side) as first from kept
group by path, line, col, code, ref, analyzer, component""", "evaluations", recursive=True)
def promotion_carriers(spark, sf_dir):
    """Each promoted finding once, with the edge sides that carried it."""
    found = merge.promotions(merge.promoted(derive(spark, sf_dir, "evaluations")))
    return found.select("ref", "component", F.size("carriers").cast("long").alias("carriers"), F.concat_ws(" ", F.col("carriers")[0].edge, F.col("carriers")[0].side).alias("first"))


@query("select edge, side, symbol, state from evaluations where state <> 'dead'", "evaluations")
def surviving_evaluations(spark, sf_dir):
    return merge.surviving(derive(spark, sf_dir, "evaluations")).select("edge", "side", "symbol", "state")


_LABELS = _PROMOTED + """,
l as (select distinct a.component a, b.component b from kept a join kept b on a.edge = b.edge and a.side <> b.side),
walk as (select distinct component a, component b from kept union select w.a, l.b from walk w join l on l.a = w.b),
sets as (select a component, min(b) s from walk group by a),
ranked as (select component, row_number() over (order by path, line, col, code, ref, analyzer) k from kept),
labels as (select component, first_value(component) over (partition by s order by k) label from (select component, s, min(k) k from sets join ranked using (component) group by all) f)"""


@query(f"{_LABELS} select label, count(*) components from labels group by label", "evaluations", recursive=True)
def component_labels(spark, sf_dir):
    """Connected sets of components over promoted pairs, named by the one whose finding comes first, and their size."""
    kept = merge.promoted(derive(spark, sf_dir, "evaluations"))
    return merge.component_labels(kept).groupBy("label").agg(F.count("*").alias("components"))


@query(f"""{_LABELS}, own as (select component, arg_min(symbols, k) symbols, arg_min(deletable, k) deletable from (select kept.*, row_number() over (order by path, line, col, code, ref, analyzer) k from kept) f group by component),
sums as (select label, cast(sum(symbols) as bigint) symbols, cast(sum(deletable) as bigint) deletable from labels join own using (component) group by label)
select component, label, symbols, deletable from labels join sums using (label)""", "evaluations", recursive=True)
def joined_sums(spark, sf_dir):
    """Counts summed over the joined sets."""
    kept = merge.promoted(derive(spark, sf_dir, "evaluations"))
    return merge.joined_sums(kept, merge.component_labels(kept))


@query(f"""{_LABELS}, caps as (select label, max(class_rank) cap from kept join labels using (component) where root = 1 and test_only = 0 group by label)
select ref, greatest(class_rank, coalesce(cap, 0)) class_rank from kept join labels using (component) left join caps using (label)""", "evaluations", recursive=True)
def confidence_cap(spark, sf_dir):
    """Promoted findings, each at the lowest class of its joined set's roots at most."""
    kept = merge.promoted(derive(spark, sf_dir, "evaluations"))
    return merge.capped(kept, merge.component_labels(kept)).select("ref", "class_rank")


@query(f"{_LABELS} select label, string_agg(distinct ref, ',' order by ref) members from kept join labels using (component) group by label", "evaluations", recursive=True)
def component_listing(spark, sf_dir):
    """The members of every joined set."""
    kept = merge.promoted(derive(spark, sf_dir, "evaluations"))
    return merge.component_members(merge.component_labels(kept), kept).select("label", F.array_join("members", ",").alias("members"))


@query("select component, count(*) symbols, cast(sum(deletable) as bigint) deletable, count(*) filter (root = 1) roots from findings group by component", "findings")
def component_sums(spark, sf_dir):
    found = derive(spark, sf_dir, "findings")
    return found.groupBy("component").agg(F.count("*").alias("symbols"), F.sum("deletable").alias("deletable"), F.count_if(F.col("root") == 1).alias("roots"))


# accounting and policy

@query("""select component, count(distinct path || chr(0) || l) as lines from (select component, path, unnest(generate_series(line, end_line)) l from findings) group by component""", "findings")
def distinct_lines(spark, sf_dir):
    return accounting.distinct_lines(derive(spark, sf_dir, "findings"), ["component"])


_SHARED = """/*with*/ each as (select distinct ref, path, line, end_line, component from carriers),
links as (select distinct a.component a, b.component b from each a join each b using (ref, path, line, end_line)),
walk as (select distinct component a, component b from each union select w.a, l.b from walk w join links l on l.a = w.b),
labels as (select a component, min(b) label from walk group by a)"""


@query(f"""{_SHARED}, several as (select ref, path, line, end_line, count(*) k from each group by all having count(*) > 1),
s as (select label, component, ref, path, line, end_line, k from each join several using (ref, path, line, end_line) join labels using (component)),
lines as (select label, component, path, unnest(generate_series(line, end_line)) l from s),
summed as (select label, sum(n) n from (select label, component, count(distinct path || chr(0) || l) n from lines group by label, component) group by label),
together as (select label, count(distinct path || chr(0) || l) n from lines group by label),
symbols as (select label, cast(sum(k - 1) as bigint) symbols from (select distinct label, ref, path, line, end_line, k from s) group by label)
select label, symbols, cast(summed.n - together.n as bigint) as lines from symbols join summed using (label) join together using (label)""", "carriers", recursive=True)
def shared_line_correction(spark, sf_dir):
    """What the summed counts of joined sets hold too often, for findings that several of their components carry."""
    carriers = derive(spark, sf_dir, "carriers")
    each = carriers.select("ref", "component").distinct()
    hubs = each.groupBy("ref").agg(F.min("component").alias("a"))
    labels = connected(each.join(hubs, "ref").select("a", F.col("component").alias("b")).distinct()).toDF("component", "label")
    return accounting.shared_line_correction(carriers, labels)


@query("""/*with*/ b as (select distinct ref from findings where severity_rank = 2 and class_rank > 0),
m as (select f.*, b.ref is not null blocked from findings f left join b on b.ref = f.ref),
l as (select component, blocked, path || chr(0) || unnest(generate_series(line, end_line)) l from m),
c as (select component, count(*) filter (blocked) symbols from m group by component having count(*) filter (blocked) > 0 and count(*) filter (not blocked) > 0)
select component, symbols, (select count(distinct l) from l where l.component = c.component) - (select count(distinct l) from l where l.component = c.component and not blocked) as lines from c""", "findings")
def unpromoted_debit(spark, sf_dir):
    """What blocked findings take from components that keep others."""
    found = derive(spark, sf_dir, "findings")
    return accounting.unpromoted_debit(found, found.where("severity_rank = 2 and class_rank > 0"))


@query("""select count(*) findings, count(*) filter (severity_rank = 0) allow, count(*) filter (severity_rank = 1) warn, count(*) filter (severity_rank = 2) deny,
(select cast(sum(m) as bigint) from (select max(deletable) m from findings where root = 1 group by component)) deletable_lines from findings""", "findings")
def totals_recount(spark, sf_dir):
    return accounting.totals(derive(spark, sf_dir, "findings"))


@query("select ref, path, deletable from findings order by deletable desc, path, line, col, code, ref, analyzer limit 100", "findings")
def top_k_cap(spark, sf_dir):
    """The report's cap: the 100 largest findings."""
    found = derive(spark, sf_dir, "findings")
    return accounting.cap(found, 100, [F.desc("deletable"), *merge.CANONICAL]).select("ref", "path", "deletable")


_VOCABULARY = ["DS3002", "DS1001", "DS2001", "DS2002", "DS9001", "DS3001", "DS1002"]


@query(f"""/*with*/ v(place, code) as (values {", ".join(str((i, c)) for i, c in enumerate(_VOCABULARY))})
select place, code from v where code in (select code from findings where severity_rank >= 2)""", "findings")
def failing_subjects(spark, sf_dir):
    """The failing codes in the vocabulary's order."""
    vocabulary = spark.createDataFrame(list(enumerate(_VOCABULARY)), "place int, code string")
    return accounting.failing_subjects(derive(spark, sf_dir, "findings"), 2, vocabulary)


@query("""/*with*/ k as (select *, row_number() over (order by deletable desc, path, line, col, code, ref, analyzer) n from findings)
select ref, cast(row_number() over (order by path, line, col, code, ref, analyzer) as integer) place, (select count(*) - 100 from findings) omitted from k where n <= 100""", "findings")
def capped_report(spark, sf_dir):
    """What the cap by size keeps, back in canonical order, and how many it omits."""
    kept, omitted = accounting.capped_report(derive(spark, sf_dir, "findings"), 100, [F.desc("deletable"), *merge.CANONICAL], list(merge.CANONICAL))
    return kept.crossJoin(F.broadcast(omitted)).select("ref", "place", "omitted")  # one row


_LEVELS = [("DS1001", 2), ("DS2", 0), ("DS3002", 1), ("DS3", 2)]
_LEVEL_SQL = f"""/*with*/ lv(code, level) as (values {", ".join(map(str, _LEVELS))}),
l as (select f.*, coalesce(x.level, y.level) configured from findings f left join lv x on x.code = f.code left join lv y on y.code = substr(f.code, 1, 3))"""


@query(f"{_LEVEL_SQL} select code, coalesce(configured, severity_rank) severity_rank, count(*) n from l group by all", "findings")
def severity_lookup(spark, sf_dir):
    """By exact code, else by family, else as it is."""
    levels = spark.createDataFrame(_LEVELS, "code string, level int")
    looked = accounting.severity_of(derive(spark, sf_dir, "findings"), levels)
    return looked.groupBy("code", F.coalesce("configured", "severity_rank").alias("severity_rank")).agg(F.count("*").alias("n"))


@query(f"""{_LEVEL_SQL} select code, analyzer, case when own and configured is not null then configured else severity_rank end severity_rank, count(*) n
from (select l.* replace (case when analyzer = 'an0' then '' else analyzer end as analyzer), analyzer = 'an0' own from l) f where not (own and configured is not null and configured = 0) group by all""", "findings")
def severity_restated(spark, sf_dir):
    """Findings without an analyzer take the configured severity and leave at allow; all others stay as they are."""
    levels = spark.createDataFrame(_LEVELS, "code string, level int")
    found = derive(spark, sf_dir, "findings").withColumn("analyzer", F.when(F.col("analyzer") == "an0", "").otherwise(F.col("analyzer")))
    return accounting.restate(found, levels).groupBy("code", "analyzer", "severity_rank").agg(F.count("*").alias("n"))


@query("select case when count(*) filter (severity_rank >= 2) > 0 then 1 else 0 end exit_code from findings", "findings")
def verdict(spark, sf_dir):
    return accounting.verdict(derive(spark, sf_dir, "findings"), 2)


# configuration

@query("""/*with*/ r as (select *, row_number() over (partition by key order by source_rank, seq) k from settings where value is not null)
select key, value, source from r where k = 1""", "settings")
def config_resolution(spark, sf_dir):
    return settings.resolve(derive(spark, sf_dir, "settings"))


@query("select key, count(distinct source) sources, count(distinct source) - 1 losing from settings where value is not null group by key", "settings")
def config_overridden(spark, sf_dir):
    return settings.overridden(derive(spark, sf_dir, "settings"))


@query("select key from (select distinct 'k' || c_custkey as key from customer) r where key not in (select key from settings where value is not null)", "settings")
def config_missing(spark, sf_dir):
    required = _read(spark, sf_dir, "customer").selectExpr("'k' || c_custkey as key").distinct()
    return settings.missing(derive(spark, sf_dir, "settings"), required)


# admission

@query("select ord, name from analyzers where conformance <> 'pass'", "analyzers")
def admission_conformance(spark, sf_dir):
    return admission.not_conformant(derive(spark, sf_dir, "analyzers"))


@query("select ord, name from analyzers where omitted > 0", "analyzers")
def admission_omitted(spark, sf_dir):
    return admission.with_omissions(derive(spark, sf_dir, "analyzers"))


@query("select name, count(*) inputs, min(ord) first_ord from analyzers group by name having count(*) > 1", "analyzers")
def admission_names(spark, sf_dir):
    return admission.repeated_names(derive(spark, sf_dir, "analyzers"))


@query("""/*with*/ f as (select target_root, 'i' || ord % 2 as i from analyzers order by ord limit 1)
select ord, name, a.target_root, 'i' || ord % 2 as target_identity from analyzers a, f where a.target_root <> f.target_root or 'i' || ord % 2 <> i""", "analyzers")
def admission_target(spark, sf_dir):
    """Inputs of another root or identity than the first."""
    return admission.other_targets(derive(spark, sf_dir, "analyzers").withColumn("target_identity", F.concat(F.lit("i"), F.col("ord") % 2)))


@query("select ord, name, version from analyzers where version not in ('1.0', '1.1', '1.2')", "analyzers")
def admission_version(spark, sf_dir):
    return admission.accepted_version(derive(spark, sf_dir, "analyzers"), ["1.0", "1.1", "1.2"])


@query("select name, count(distinct version || '/' || nation) forms from analyzers group by name having count(distinct version || '/' || nation) > 1", "analyzers")
def admission_collisions(spark, sf_dir):
    return admission.collisions(derive(spark, sf_dir, "analyzers"), "name", ["version", "nation"])


# routing

_CONSUMERS = "select c_custkey as consumer, array(c_mktsegment, 'n' || (c_nationkey % 9)) as languages from customer"
_PROVIDERS = "select s_suppkey as provider, array('n' || (s_nationkey % 7), 'x' || (s_suppkey % 5)) as languages from supplier"
_ROUTE = """c as (select c_custkey consumer, unnest([c_mktsegment, 'n' || (c_nationkey % 9)]) l from customer),
p as (select s_suppkey provider, unnest(['n' || (s_nationkey % 7), 'x' || (s_suppkey % 5)]) l from supplier)"""


def _route_sides(spark, sf_dir):
    for name in ("customer", "supplier"):
        _read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_CONSUMERS), spark.sql(_PROVIDERS)


@query(f"with {_ROUTE} select distinct consumer, provider from c join p using (l)")
def routing_pairs(spark, sf_dir):
    return routing.route(*_route_sides(spark, sf_dir))


@query(f"with {_ROUTE} select distinct consumer from c where consumer not in (select consumer from c join p using (l))")
def routing_unclaimed(spark, sf_dir):
    return routing.unclaimed(*_route_sides(spark, sf_dir))


@query(f"with {_ROUTE} select distinct l as language from c where l not in (select l from p)")
def routing_uncovered(spark, sf_dir):
    return routing.uncovered_languages(*_route_sides(spark, sf_dir))


@query("""/*with*/ u as (select distinct 'root://' || col || '/' || path ref, 'root://' || col scheme, analyzer from findings where class_rank = 0),
rd as (select distinct 'root://' || col scheme, analyzer from findings where root = 1 or analyzer <> 'an1')
select distinct ref, analyzer from u where (select count(distinct analyzer) from u v where v.ref = u.ref) >= (select count(distinct analyzer) from rd where rd.scheme = u.scheme)
and exists (select 1 from rd where rd.scheme = u.scheme)""", "findings")
def unmatched_roots(spark, sf_dir):
    found = derive(spark, sf_dir, "findings")
    scheme = F.concat(F.lit("root://"), "col")
    reported = found.where("class_rank = 0").select(F.concat(scheme, F.lit("/"), "path").alias("ref"), scheme.alias("scheme"), "analyzer").distinct()
    readers = found.where("root = 1 or analyzer <> 'an1'").select(scheme.alias("scheme"), "analyzer").distinct()
    return routing.unmatched_roots(reported, readers)


# paths

_SHORT = "select distinct regexp_replace(path, '^[^/]*/', '') as path from files"


@query(f"""/*with*/ r as ({_SHORT}), l as (select distinct path from files)
select l.path left_path, r.path right_path from l, r where l.path = r.path or ends_with(l.path, '/' || r.path) or ends_with(r.path, '/' || l.path)""", "files")
def suffix_file_join(spark, sf_dir):
    files = derive(spark, sf_dir, "files")
    files.createOrReplaceTempView("files")
    return paths.same_file(files, spark.sql(_SHORT))


_DIRS = "select distinct split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as dir from files where path like '%/%/%' union select distinct split_part(path, '/', 1) from files"


@query(f"""/*with*/ d as ({_DIRS}), l as (select distinct path from files)
select l.path, arg_max(d.dir, length(d.dir)) dir from l left join d on l.path = d.dir or starts_with(l.path, d.dir || '/') group by l.path""", "files")
def prefix_join(spark, sf_dir):
    files = derive(spark, sf_dir, "files")
    files.createOrReplaceTempView("files")
    return paths.nearest_ancestor(files, spark.sql(_DIRS))


@query("select split_part(path, '.', 1) host, count(*) hits from files where regexp_matches(path, '^.*example.*/[a-z][a-z]/.*$') group by 1", "files")
def glob_match(spark, sf_dir):
    hit = F.col("path").rlike(paths.glob_regex("*example*/")[:-1] + "[a-z][a-z]/.*$")
    return derive(spark, sf_dir, "files").where(hit).groupBy(F.split_part("path", F.lit("."), F.lit(1)).alias("host")).agg(F.count("*").alias("hits"))


@query("""/*with*/ g as (select split_part(path, '.', 1) host, path from files),
p as (select host, path, string_split(path, '/') s from g),
n as (select host, count(*) n from g group by host),
k as (select host, d, array_to_string(s[1:d], '/') dir, count(*) k from (select host, path, s, unnest(range(1, len(s) + 1)) d from p) group by all),
b as (select host, arg_max(dir, d) dir from k join n using (host) where k = n group by host)
select host, coalesce(dir, '') dir from n left join b using (host)""", "files")
def common_ancestor(spark, sf_dir):
    rows = derive(spark, sf_dir, "files").select(F.split_part("path", F.lit("."), F.lit(1)).alias("host"), "path")
    return paths.common_directory(rows, ["host"])


_CENSUS = {
    "two": paths.Language(endings=("2", "4"), skipped_dirs=("en", "de"), skipped_files=("42", "4")),
    "zero": paths.Language(markers=("index", "7"), endings=("0", "5"), skipped_dirs=("fr",)),
    "odd": paths.Language(markers=("2",), endings=("1", "3", "7", "9")),
}


@query("""select language, count(*) files from (
select unnest(list_filter([case when right(path, 1) in ('2', '4') and n not in ('42', '4') and not list_has_any(d, ['en', 'de']) then 'two' end,
 case when (right(path, 1) in ('0', '5') or n in ('index', '7')) and not list_has_any(d, ['fr']) then 'zero' end,
 case when right(path, 1) in ('1', '3', '7', '9') or n = '2' then 'odd' end], lambda x: x is not null)) language
from (select path, string_split(path, '/')[-1] n, string_split(path, '/')[1:len(string_split(path, '/')) - 1] d from files)) group by language""", "files")
def census(spark, sf_dir):
    return paths.census(derive(spark, sf_dir, "files"), _CENSUS)


# suppressions

@query("""with s as (select source path, cast(doc_id as varchar) symbol, case when toxic = 1 then null else 'because' end reason, quality from labels join documents using (doc_id)),
d as (select source path, cast(doc_id as varchar) symbol from documents where lang <> 'de')
select s.path, count(*) filter (d.symbol is not null) in_effect, count(*) filter (d.symbol is not null and reason is not null) reasons, count(*) filter (d.symbol is null) stale
from s left join d on s.symbol = d.symbol and s.path = d.path group by s.path""")
def suppression_binding(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = _read(spark, sf_dir, "labels").join(docs, "doc_id")
    wanted = known.select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("symbol"), F.when(F.col("toxic") == 1, None).otherwise("because").alias("reason"))
    there = docs.where("lang <> 'de'").select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("symbol"))
    return suppression.counts(suppression.bind(wanted, there))


@query("""/*with*/ b as (select ref, min(case when deletable > 45 then 1 when col > 5 then 2 end) p from findings group by ref),
r as (select ref, p from findings join b using (ref))
select coalesce(case p when 1 then 'large' when 2 then 'late' end, 'none') reason, count(*) n from r group by 1""", "findings")
def suppression_hold(spark, sf_dir):
    found = derive(spark, sf_dir, "findings")
    large = found.where("deletable > 45").select("ref", F.lit("large").alias("reason"), F.lit(1).alias("priority"))
    late = found.where("col > 5").select("ref", F.lit("late").alias("reason"), F.lit(2).alias("priority"))
    return suppression.held(found.select("ref"), large.unionByName(late)).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


# ranges and graphs

@query("select a.owner, a.member as first, b.member as second from ranges a join ranges b on a.owner = b.owner and a.member < b.member and a.e > b.s and b.e > a.s", "ranges")
def range_overlap(spark, sf_dir):
    return ranges.overlaps(derive(spark, sf_dir, "ranges"))


@query("""select owner, min(n) free from (select owner, unnest(range(1, 80)) n from (select distinct owner from ranges)) p
where not exists (select 1 from ranges r where r.owner = p.owner and r.s <= n and n < r.e) group by owner""", "ranges")
def range_next_free(spark, sf_dir):
    return ranges.next_free(derive(spark, sf_dir, "ranges")).select("owner", F.col("free").cast("long").alias("free"))


@query("""select distinct p.owner, p.n from (select l_orderkey as owner, cast(l_suppkey % 70 as int) n from lineitem) p join ranges r on r.owner = p.owner and r.s <= n and n < r.e""", "ranges")
def range_points(spark, sf_dir):
    points = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as owner", "cast(l_suppkey % 70 as int) as n")
    return ranges.inside(points, derive(spark, sf_dir, "ranges"))


@query("select owner, s, member from (select *, row_number() over (partition by owner, s order by member) k from ranges) where k > 1", "ranges")
def unique_numbers(spark, sf_dir):
    return ranges.repeated(derive(spark, sf_dir, "ranges"), ["owner", "s"], ["member"]).select("owner", "s", "member")


@query("""/*with*/ r as (select src as node from links where seed union select l.dst from r join links l on l.src = r.node) select node from r""", "links", recursive=True)
def reachability(spark, sf_dir):
    """Orders that a dear one leads to."""
    links = derive(spark, sf_dir, "links")
    return reachable(links.where("seed").select(F.col("src").alias("node")), links)


@query("""/*with*/ u as (select src a, dst b from links union select dst, src from links),
w as (select a, b from u union select w.a, u.b from w join u on u.a = w.b)
select a node, least(a, min(b)) label from w group by a""", "links", recursive=True)
def connected_sets(spark, sf_dir):
    return connected(derive(spark, sf_dir, "links").select(F.col("src").alias("a"), F.col("dst").alias("b")))


# binding facts

_BINDINGS = """/*with*/ same as (select a.idx a, b.idx b from records a join records b on a.schema = b.schema and (a.schema_file = b.schema_file or suffix(a.schema_file, '/' || b.schema_file) or suffix(b.schema_file, '/' || a.schema_file))),
near as (select a.idx a, b.idx b from records a join records b on a.role = 'fallback' and b.role = 'schema' and (a.schema_file = b.schema_file or suffix(a.schema_file, '/' || b.schema_file) or suffix(b.schema_file, '/' || a.schema_file))
  and (a.scope = 'all' or b.kind not in ('service', 'rpc'))),
binds as (select m.a, m.b from same m join records a on a.idx = m.a and a.role = 'consumer' join records b on b.idx = m.b and b.role = 'schema' and b.state = 'dead'
  union select n.a, n.b from near n join records b on b.idx = n.b and b.state = 'dead'),
graded as (select s.idx, s.component, s.schema_file, s.schema, bool_or(a.idx is not null) is_bound,
  case when (coalesce(bool_or(a.cap is not null), false) and s.class_rank <> 0) or coalesce(bool_or(a.library), false) then 2 else s.class_rank end class_rank
  from records s left join binds x on x.b = s.idx left join records a on a.idx = x.a where s.role = 'schema' and s.state = 'dead' group by s.idx, s.component, s.schema_file, s.schema, s.class_rank),
impl as (select analyzer, symbol, min(idx) idx, min_by(state, idx) state, min_by(component, idx) component from records where role = 'implementer' group by analyzer, symbol),
named as (select r.idx, r.role, r.state, r.component, i.idx first_idx, i.state first_state, i.component first_component from (select *, unnest(split(via_list, ',')) name from records) r left join impl i on i.analyzer = r.analyzer and i.symbol = r.name),
members as (select s.component, s.idx, t.idx member, t.component member_component, t.state member_state from (select *, unnest(split(members_list, ',')) m from records where role = 'schema' and state = 'dead') s
  join records t on t.role = 'schema' and t.schema = s.m and (s.schema_file = t.schema_file or suffix(s.schema_file, '/' || t.schema_file) or suffix(t.schema_file, '/' || s.schema_file))),
implementing as (select i.idx, i.component, s.idx schema_idx, s.component schema_component, s.state schema_state from records i join same m on m.a = i.idx join records s on s.idx = m.b and s.role = 'schema' where i.role = 'implementer' and i.state = 'dead'),
seeds as (select '#' || idx node from records where role = 'fallback' or state is null or (state = 'live' and not (role = 'consumer' and via_list is not null))
  union select '#' || idx from named where role = 'consumer' and first_idx is null
  union select component from graded where not is_bound
  union select component from records i where role = 'implementer' and state = 'dead' and not exists (select 1 from implementing m where m.idx = i.idx)),
arcs as (select component src, '#' || idx dst from records where state = 'dead' and role <> 'fallback'
  union select '#' || first_idx, case role when 'consumer' then '#' || idx else component end from named where first_idx is not null and (role = 'consumer' or (role = 'implementer' and state = 'dead'))
  union select '#' || b.a, r.component from binds b join records r on r.idx = b.b
  union select '#' || member, component from members
  union select '#' || schema_idx, component from implementing
  union select '#' || u.idx, s.component from (select *, unnest(split(uses_list, ',')) used from records where role = 'schema') u join records s on s.schema = u.used and s.role = 'schema' and s.state = 'dead'),
reached as (select node from seeds union select a.dst from reached r join arcs a on a.src = r.node)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {name: F.split(f"{name}_list", ",") for name in ("via", "uses", "members")}
    return derive(spark, sf_dir, "records").withColumns(lists).drop("via_list", "uses_list", "members_list")


@query(f"{_BINDINGS} select node component from reached where node not like '#%'", "records", recursive=True)
def binding_dropped(spark, sf_dir):
    """Components that the rules of schemas, implementers and recursive reads drop."""
    return bindings.dropped(bindings.live_nodes(_records(spark, sf_dir)))


@query(f"""{_BINDINGS} select idx, 'schema' as role, component, class_rank from graded where component not in (select node from reached)
union all select idx, role, component, class_rank from records where role = 'implementer' and state = 'dead' and component not in (select node from reached)""", "records", recursive=True)
def binding_promoted(spark, sf_dir):
    records = _records(spark, sf_dir)
    return bindings.promoted(records, bindings.live_nodes(records))


@query(f"{_BINDINGS} select distinct component from graded where class_rank > 1", "records", recursive=True)
def binding_withheld(spark, sf_dir):
    """Components that a minimum confidence of probable holds back."""
    return bindings.withheld(_records(spark, sf_dir), 1)


@query(f"""{_BINDINGS}, pairs as (select g.component, n.first_component other from named n join binds b on b.a = n.idx join graded g on g.idx = b.b
  where n.role = 'consumer' and n.first_state = 'dead' and '#' || n.idx not in (select node from reached)
union select schema_component, component from implementing where schema_state = 'dead'
union select member_component, component from members where member_state = 'dead')
select distinct component, other from pairs where component <> other and component not in (select node from reached) and other not in (select node from reached)""", "records", recursive=True)
def binding_joins(spark, sf_dir):
    records = _records(spark, sf_dir)
    return bindings.joins(records, bindings.live_nodes(records))


@query(f"""{_BINDINGS.replace("reached as (select node from seeds union select a.dst from reached r join arcs a on a.src = r.node)", "")}
low as (select distinct component from graded where class_rank > 1),
reached as (select node from (select node from seeds union select component from low) s union select a.dst from reached r join arcs a on a.src = r.node)
select node component from reached where node not like '#%'""", "records", recursive=True)
def withheld_seeds(spark, sf_dir):
    """What drops where a minimum confidence of probable holds components back too."""
    return bindings.dropped(bindings.live_nodes(_records(spark, sf_dir), minimum=1))


@query(f"""{_BINDINGS.replace("reached as (select node from seeds union select a.dst from reached r join arcs a on a.src = r.node)", "")}
low as (select component, max(class_rank) - 1 as level from graded group by component having max(class_rank) > 0),
levels as (select unnest([0, 1]) level),
reached as (select level, node from levels, seeds union select level, component from low join levels using (level) union select v.level, l.component from low l join levels v on v.level < l.level
  union select r.level, a.dst from reached r join arcs a on a.src = r.node),
base as (select node from seeds union select a.dst from base b join arcs a on a.src = b.node),
kept as (select idx, component, class_rank from graded where component not in (select node from base)
  union all select idx, component, class_rank from records where role = 'implementer' and state = 'dead' and component not in (select node from base))
select level, count(*) n from kept k join levels v on exists (select 1 from reached r where r.level = v.level and r.node = k.component) group by level""", "records", recursive=True)
def withheld_counts(spark, sf_dir):
    """For each minimum confidence how many promotions it holds back."""
    return bindings.withheld_counts(_records(spark, sf_dir), [0, 1])


_JOINT = f"""{_BINDINGS.replace("reached as (select node from seeds union select a.dst from reached r join arcs a on a.src = r.node)", "")}
pairs as (select 'wire/' || (idx % 4001) as edge, case when role = 'schema' then 'provides' else 'used_by' end as side, case when idx % 53 = 0 then 'live' else 'dead' end as state, component from records where role in ('schema', 'implementer')),
deadp as (select * from pairs where state = 'dead'),
pair_seeds as (select d.component node from deadp d where exists (select 1 from pairs o where o.edge = d.edge and o.side <> d.side)
  and (exists (select 1 from pairs o where o.edge = d.edge and o.side <> d.side and o.state = 'live') or not exists (select 1 from pairs o where o.edge = d.edge and o.side <> d.side and o.state = 'dead'))),
pair_arcs as (select distinct o.component src, d.component dst from deadp d join deadp o on o.edge = d.edge and o.side <> d.side),
all_arcs as (select src, dst from arcs union select src, dst from pair_arcs),
reached as (select node from (select node from seeds union select node from pair_seeds) s union select a.dst from reached r join all_arcs a on a.src = r.node)"""


@query(f"{_JOINT} select node component from reached where node not like '#%'", "records", recursive=True)
def joint_fixpoint(spark, sf_dir):
    """Components that the edge rule and the binding rules drop together, each reading what the other drops."""
    records = _records(spark, sf_dir)
    pairs = records.where("role in ('schema', 'implementer')").selectExpr(
        "analyzer", "'wire/' || (idx % 4001) as edge", "case when role = 'schema' then 'provides' else 'used_by' end as side", "symbol", "case when idx % 53 = 0 then 'live' else 'dead' end as state", "component")
    return bindings.dropped(bindings.live_nodes(records, evaluations=pairs))


@query(f"{_BINDINGS} select schema_file from graded group by schema_file having not bool_or(is_bound)", "records", recursive=True)
def unbound_schema_notes(spark, sf_dir):
    return bindings.unbound_files(_records(spark, sf_dir))


# declarations of schema files

@query("""/*with*/ f as (select distinct path from findings), m as (select 'pkg' || i as dir, 'pkg' || i || '/f' || i || '.go' as out_of, i from range(0, 50, 3) t(i)),
h as (select f.path, bool_or(i % 2 = 0) said from f join m on starts_with(f.path, m.dir || '/') group by f.path)
select f.path, coalesce(h.said, true) built from f left join h using (path)""", "findings")
def module_files(spark, sf_dir):
    """Files under modules that include their own directory (even) or exclude it (odd)."""
    modules = spark.range(0, 50, 3).selectExpr("'pkg' || id as dir", "array('pkg' || id) as includes", "case when id % 2 = 1 then array('pkg' || id) end as excludes")
    return schema_rules.built(derive(spark, sf_dir, "findings").select("path").distinct(), modules)


_UPSTREAM = [("pkg1*/*.go", "DS1", False), ("f*.go", "DS", True)]


@query("""/*with*/ f as (select distinct path, case when component like '%7' then 'DS.x' when component like '%8' then 'DS1' else 'DSX' end package from findings)
select path, package, case when package = 'DS1' and regexp_matches(path, '^pkg1[^/]*/[^/]*[.]go$') then path when package = 'DS.x' then split_part(path, '/', 2) end copy_of from f""", "findings")
def vendored_copies(spark, sf_dir):
    package = F.expr("case when component like '%7' then 'DS.x' when component like '%8' then 'DS1' else 'DSX' end")
    return schema_rules.vendored(derive(spark, sf_dir, "findings").select("path", package.alias("package")).distinct(), _UPSTREAM)


@query("""/*with*/ d as (select distinct src as ref, case when src % 7 = 0 then 'service' when src % 5 = 0 then 'rpc' else 'message' end kind, src % 14 = 0 http, src % 11 = 0 unknown_generation, src % 13 = 0 explicit_json from links),
r as (select ref from d where kind = 'service' and http union select l.dst from r join links l on l.src = r.ref)
select ref, case when kind in ('service', 'rpc') or unknown_generation or explicit_json or ref in (select ref from r) then 2 else 1 end class_rank from d""", "links", recursive=True)
def declaration_classes(spark, sf_dir):
    links = derive(spark, sf_dir, "links")
    declared = links.select(F.col("src").alias("ref")).distinct().selectExpr(
        "ref", "case when ref % 7 = 0 then 'service' when ref % 5 = 0 then 'rpc' else 'message' end as kind",
        "ref % 14 = 0 as http", "ref % 11 = 0 as unknown_generation", "ref % 13 = 0 as explicit_json")
    return schema_rules.classified(declared, schema_rules.http_reached(declared, links), closed=False).select("ref", "class_rank")


@query("""with v as (select l_orderkey enum, l_linenumber place, min(l_partkey % 9) number, l_orderkey || '.' || l_linenumber ref, l_orderkey % 2 = 0 open from lineitem group by l_orderkey, l_linenumber),
h as (select ref, case when open and place = min(place) over (partition by enum) then 'default-value' when count(*) over (partition by enum, number) > 1 then 'shared-number' end reason from v)
select ref, reason from h where reason is not null""")
def enum_exemptions(spark, sf_dir):
    """First reason wins for a value that both rules hold."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.expr("l_partkey % 9")).alias("number"))
    values = lines.selectExpr("l_orderkey as enum", "l_linenumber as place", "number", "l_orderkey || '.' || l_linenumber as ref", "l_orderkey % 2 = 0 as open")
    return suppression.held(values.select("ref"), schema_rules.enum_holds(values)).where("reason is not null")


@query("""with d as (select l_orderkey || '/' || l_linenumber ref, l_orderkey, l_linenumber from lineitem)
select ref from d where exists (select 1 from orders where o_orderkey = l_orderkey and o_custkey % 7 = l_linenumber)""")
def unresolved_type_holds(spark, sf_dir):
    declared = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey || '/' || l_linenumber as ref", "array(l_orderkey, cast(l_linenumber as bigint)) as path")
    types = _read(spark, sf_dir, "orders").selectExpr("array(o_orderkey, o_custkey % 7, 6L) as path")
    return schema_rules.unresolved_holds(declared, types).select("ref")


# documents and renderings

@query("""select 'e' || o_orderkey as edge, 'provides' as side, 'proto://p#S' || o_custkey as symbol from orders where o_custkey % 3 = 0
union all select 'e' || o_orderkey, 'used_by', 'proto://q#S' || o_orderkey from orders where o_orderkey % 5 = 0""")
def edges_scan(spark, sf_dir):
    """Sides of a scheme from edges documents in JSON."""
    sides = F.expr("""to_json(named_struct('edges', map('e' || o_orderkey, map('provides', case when o_custkey % 3 = 0 then 'proto://p#S' else 'go://p#S' end || o_custkey,
        'used_by', case when o_orderkey % 5 = 0 then 'proto://q#S' else 'ts://q#S' end || o_orderkey))))""")
    return documents.edges(_read(spark, sf_dir, "orders").select(sides.alias("content")), "proto")


@query("select 'part.' || k as key, case k when 'size' then cast(p_size as varchar) when 'brand' then p_brand end as value, count(*) n from part, (values ('size'), ('brand')) t(k) group by all")
def settings_scan(spark, sf_dir):
    """Dotted settings of nested documents; a key that no document states gives no row."""
    stated = _read(spark, sf_dir, "part").selectExpr("to_json(named_struct('part', named_struct('size', p_size, 'brand', p_brand))) as content")
    return documents.settings(stated, ["part.size", "part.brand", "part.none"], 1, "repository").groupBy("key", "value").agg(F.count("*").alias("n"))


@query("""select path, line, path || ':' || line || ':' || col || ': ' || case severity_rank when 0 then 'allow' when 1 then 'warn' else 'deny' end || ' ' || code || ' unused ' || ref as value from findings""", "findings")
def text_rendering(spark, sf_dir):
    return outputs.finding_lines(_rendered(spark, sf_dir)).select("path", "line", "value")


@query("""select path, line, '::' || case severity_rank when 2 then 'error' else 'warning' end || ' file=' || path || ',line=' || line || ',col=' || col || ',title=' || code || '::unused ' || ref as value from findings""", "findings")
def annotation_rendering(spark, sf_dir):
    return outputs.annotation_lines(_rendered(spark, sf_dir)).select("path", "line", "value")


@query("""/*with*/ r as (select *, row_number() over (partition by component order by path, line, col, code, ref, analyzer) k, count(*) over (partition by component) n from findings)
select component, code as rule, 'unused ' || ref as message, n - 1 as related from r where k = 1""", "findings")
def sarif_rendering(spark, sf_dir):
    """A result per component, read back from its JSON: the first finding and how many places relate to it."""
    read = outputs.sarif_results(_rendered(spark, sf_dir)).select("component", F.from_json("result", "ruleId string, message struct<text: string>, relatedLocations array<struct<physicalLocation: string>>").alias("r"))
    return read.select("component", F.col("r.ruleId").alias("rule"), F.col("r.message.text").alias("message"), F.size("r.relatedLocations").cast("long").alias("related"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("case severity_rank when 0 then 'allow' when 1 then 'warn' else 'deny' end")
    return derive(spark, sf_dir, "findings").withColumns({"severity": severity, "message": F.concat(F.lit("unused "), "ref")})


# scalar functions

@query("""with w as (select distinct c_mktsegment n from customer), x as (select lower(n) || '_' || lower(n) || '_id' s, upper(n) || '_KIND' u from w)
select s, split_part(s, '_', 1) || upper(substr(split_part(s, '_', 2), 1, 1)) || substr(split_part(s, '_', 2), 2) || 'Id' json_name,
 upper(substr(u, 1, 1)) || lower(substr(split_part(u, '_', 1), 2)) || 'Kind' pascal, 'sha256:' || sha256(s) digest from x""")
def name_styles(spark, sf_dir):
    w = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("n")).distinct()
    x = w.select(F.expr("lower(n) || '_' || lower(n) || '_id'").alias("s"), F.expr("upper(n) || '_KIND'").alias("u"))
    return x.select("s", names.json_name("s").alias("json_name"), names.pascal_case("u").alias("pascal"), names.digest("s").alias("digest"))


@query("select page_id, split_part(url, '://', 1) scheme, len(regexp_split_to_array(html, '\\r\\n|\\r|\\n')) lines from pages")
def ref_schemes(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", names.scheme("url").alias("scheme"), F.size(names.log_lines("html")).cast("long").alias("lines"))


from tributary import catalog_more  # noqa: E402, F401  its queries are registered on import
