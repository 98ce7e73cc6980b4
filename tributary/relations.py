"""Relations of the merge engine derived from the driver's tables.

Each is one SELECT in SQL that Spark and the oracle both read, so operators and
their oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# codes, kinds and levels below are ours, chosen to have every outcome in the test tables
DERIVED = {
    "evaluations": ("orders", """
select 'an' || (o_custkey % 2) as analyzer, 'wire/' || (o_orderkey % 7001) as edge,
       case when o_custkey % 2 = 0 then 'provides' else 'used_by' end as side, 's' || o_orderkey as symbol,
       case when o_totalprice > 498000 then 'live' when o_totalprice < 2000 then 'absent' else 'dead' end as state,
       'an' || (o_custkey % 2) || '/c-' || (o_orderkey % 9973) as component,
       'p' || (o_orderkey % 89) || '.go' as path, cast(o_orderkey % 401 + 1 as int) as line, cast(o_orderkey % 401 + 1 + o_custkey % 6 as int) as end_line, cast(o_custkey % 5 as int) as col,
       'DS' || (o_custkey % 3 + 1) || '001' as code, 's' || o_orderkey as ref, cast(o_custkey % 4 + 1 as int) as symbols, cast(o_orderkey % 23 as int) as deletable,
       cast(o_custkey % 3 as int) as class_rank, cast(o_orderkey % 3 = 0 as int) as root, cast(o_orderkey % 7 = 0 as int) as test_only
from orders"""),
    "carriers": ("lineitem", """
select 'f' || l_partkey as ref, 'pkg' || (l_partkey % 40) || '.go' as path, cast(l_partkey % 300 + 1 as int) as line, cast(l_partkey % 300 + 1 + l_partkey % 7 as int) as end_line,
       'go/c-' || (l_partkey % 40) || '-' || (l_suppkey % 6) as component
from lineitem"""),
    "findings": ("lineitem", """
select 'an' || (l_suppkey % 3) as analyzer, 'pkg' || (l_partkey % 50) || '/f' || (l_partkey % 200) || '.go' as path,
       cast(l_orderkey % 500 + 1 as int) as line, cast(l_orderkey % 500 + 1 + cast(l_quantity as int) % 20 as int) as end_line,
       l_linenumber as col, 'DS' || case l_returnflag when 'A' then '1' when 'N' then '2' else '3' end || case l_linestatus when 'F' then '001' else '002' end as code,
       's' || l_orderkey || '/' || l_linenumber as ref, 'an' || (l_suppkey % 3) || '/c-' || (l_orderkey % 97) as component,
       cast(l_linenumber = 1 as int) as root, cast(l_partkey % 3 as int) as class_rank, cast(l_suppkey % 3 as int) as severity_rank,
       cast(l_quantity as int) as deletable, cast(l_linenumber % 4 = 3 as int) as test_only
from lineitem"""),
    "settings": ("events", """
select 'k' || user_id as key, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else 3 end as source_rank,
       event_type as source, event_id as seq, cast(floor(value) as int) as value
from events"""),
    "analyzers": ("supplier", """
select 'tool-' || (s_suppkey % 40) as name, '1.' || (s_suppkey % 7) as version, 'root' || (s_nationkey % 2) as target_root, s_nationkey as nation,
       case when s_suppkey % 11 = 0 then 'fail' else 'pass' end as conformance, cast(s_suppkey % 13 = 0 as int) as omitted, s_suppkey as ord
from supplier"""),
    "files": ("pages", """
select page_id as file_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages"""),
    "ranges": ("lineitem", """
select l_orderkey as owner, l_linenumber as member, cast(l_partkey % 60 as int) as s, cast(l_partkey % 60 + cast(l_quantity as int) % 9 + 1 as int) as e from lineitem"""),
    "records": ("orders", """
with n as (select o_orderkey as idx, o_orderkey % 10 as r, cast(floor(o_orderkey / 10) as bigint) as q, o_totalprice as price, o_custkey as c from orders)
select idx, case when r between 4 and 7 then 'wire' else 'go' end as analyzer,
       case when r between 4 and 7 then 'schema' when r = 8 then 'implementer' when r = 9 and q % 50 = 0 then 'fallback' else 'consumer' end as role,
       case when r between 4 and 7 then case when price > 350000 then 'live' else 'dead' end when r = 8 then 'dead'
            when q % 9 = 0 then 'live' when q % 31 = 0 then null else 'unreferenced' end as state,
       case when (r < 4 or r = 9) and q % 28 = 5 then 'x' else 'm' end || case when r between 4 and 7 then q * 4 + r - 4 when r = 8 then q * 4 + 3 when r < 4 then q * 4 + r else q * 4 end as schema,
       case when r % 2 = 0 then 'proto/' else '' end || 'p' || (q % 40) || '/f' || (q % 7) || '.proto' as schema_file,
       case when r = 8 then 'i' || q else 's' || idx end as symbol,
       case when r between 4 and 7 then 'wire/c-' || (q * 4 + r - 4) when r = 8 then 'go/c-' || q else 'go/o-' || idx end as component,
       case when r = 7 then 'rpc' else 'message' end as kind, case when q % 100 = 0 then 'all' else 'types' end as scope,
       cast(q % 3 as int) as class_rank, case when c % 11 = 0 then 'strict' end as cap, c % 13 = 0 as library,
       case when r = 3 then 'i' || (q + case when q % 8 = 0 then 100000000 else 0 end) when r = 8 and q % 3 = 0 then 'i' || (q - 1) end as via_list,
       case when r between 4 and 7 and q % 5 = 0 then 'm' || cast(floor((q * 4 + r - 4) / 2) as bigint) end as uses_list,
       case when r = 4 then 'm' || (q * 4 + 1) || ',m' || (q * 4 + 2) end as members_list
from n"""),
    "symbols": ("orders", """
select o_orderkey as ord, case when o_orderkey % 10 = 0 then 'pkg' || (o_custkey % 30) when o_orderkey % 37 = 0 then 'pkg' || (o_custkey % 30) || '.M' || (o_orderkey % 300) || '.M' || (o_custkey % 40)
       else 'pkg' || (o_custkey % 30) || '.M' || (o_orderkey % 300) end as full_name,
       case when o_orderkey % 10 = 0 and o_totalprice < 400000 then 'package' when o_orderkey % 3 = 0 then 'enum' when o_orderkey % 7 = 0 then 'field' else 'message' end as kind, 'f' || (o_custkey % 13) || '.proto' as file
from orders"""),
    "type_names": ("lineitem", """
select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as idx,
       'pkg' || (l_partkey % 30) || '.M' || (l_orderkey % 300) || '.f' as relative_to,
       case l_linenumber % 4 when 0 then 'M' || (l_suppkey % 40) when 1 then 'pkg' || (l_suppkey % 33) || '.M' || (l_partkey % 300) when 2 then '.pkg' || (l_suppkey % 33) || '.M' || (l_partkey % 300)
       else 'M' || (l_orderkey % 300) || '.M' || (l_suppkey % 40) end as name,
       case when l_returnflag = 'A' then 'message' when l_returnflag = 'R' and l_quantity > 25 then 'enum' end as written
from lineitem"""),
    "fields": ("lineitem", """
select 'M' || l_orderkey as owner, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as place,
       case when l_partkey % 4 = 0 then '_' else '' end || 'field_' || (l_partkey % 3) || case when l_suppkey % 2 = 0 then '_id' else 'Id' end as name,
       case when l_suppkey % 7 = 0 then 'field' || (l_partkey % 3) || 'Id' when l_suppkey % 11 = 0 then '[x]' end as custom, l_orderkey % 2 = 0 as legacy,
       cast(l_partkey % 9 + 1 as int) as number, l_linenumber = 3 as is_extension, case l_returnflag when 'A' then 'repeated' when 'N' then 'optional' else 'required' end as label,
       case when l_linestatus = 'F' then 'string' when l_quantity > 30 then 'int32' else 'message' end as type, l_suppkey % 3 = 0 as packed, l_suppkey % 5 = 0 as lazy, l_suppkey % 13 = 0 as unverified_lazy,
       l_suppkey % 4 = 0 as has_ctype, case when l_orderkey % 3 = 0 then 2024 when l_orderkey % 3 = 1 then 2023 else 1000 end as edition, l_returnflag = 'N' as optional,
       case when l_partkey % 6 = 0 then 'string' end as key_type
from lineitem"""),
    "enum_values": ("lineitem", """
select 'E' || l_orderkey as enum, case when l_orderkey % 2 = 0 then 'Some_Kind' else 'Mode' end as enum_name, l_orderkey % 3 = 0 as open, l_orderkey % 5 = 0 as allow_alias,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as place, cast(l_partkey % 6 as int) as number,
       case l_suppkey % 4 when 0 then 'SOME_KIND_' when 1 then 'somekind__' when 2 then 'MODE_' else '' end || case when l_partkey % 2 = 0 then 'on' else 'ON' end || case when l_partkey % 5 = 0 then '' else '_' || (l_partkey % 5) end as name
from lineitem"""),
    "links": ("orders", """
select src, dst, seed from (select o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as dst, o_totalprice > 400000 as seed,
       o_orderstatus as status, lead(o_orderstatus) over (partition by o_custkey order by o_orderkey) as next_status from orders) f where status = next_status"""),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = DERIVED[name]
    spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(source)
    return spark.sql(sql)


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """Oracle SQL that begins with the derived relations."""
    views = ", ".join(f"{n} as ({DERIVED[n][1]})" for n in names)
    return f"with {'recursive ' if recursive else ''}{views}{',' if body.lstrip().startswith('/*with*/') else ''} {body}"
