"""Secret scans over an incremental ledger of blobs.

Every version of every text is content-addressed by SHA-256. The ledger is four tables
under one folder:

* ``blobs``: each distinct text once, in batches, one for each :meth:`Ledger.record`;
* ``history``: doc_id, version, blob of every row that was ever recorded;
* ``scans``: which batch which rule, in which version, has scanned in which run;
* ``found``: the spans that each run found, by blob.

A batch that a run has scanned is recorded only after what it found is written, so a
run that dies leaves nothing half recorded: its rows in ``found`` belong to no
recorded run and are never read. An update scans the batches' blobs with just the rules
whose version hasn't scanned them, historical versions included, each blob once however
many paths and versions hold it. Findings are joined back to all paths. Two writers that
record or scan the same blob at the same time give the same spans, which count once.

All of it is Spark SQL functions. Spans come from the lengths of matches and of the
text between them, summed in a window over each blob's matches.

Defined cases: a null or empty text is the empty blob, without findings; repeated
rows and rows with null or equal ids are returned each; an empty table gives an
empty result; extra columns are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.shared import Scratch, table

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
BLOBS = "blob string, text string, batch string"
SCANS = "batch string, rule string, run string"
FOUND = "blob string, found array<struct<start:bigint,end:bigint,kind:string,rule:string>>, run string"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches, leftmost first and not overlapping, count if group ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    has: str = ""  # a text without it has no match

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the patterns of the rules
_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_RULES = (
    Rule("assign", 1, _ASSIGN, 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", has="AKIA"),  # a match of AKIA[A-Z0-9]+ takes its whole run, so the length can stand in the pattern
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
RULES = (
    *BASE_RULES,
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", has="-----BEGIN "),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", has="eyJ"),
)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(rule: Rule, rank: int) -> Column:
    """The rule's matches in ``text``: rank, kind, the length of the text before each (from the last one's end), the match."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.split("text", rule.pattern, -1)
    found = F.when(
        F.size(hits) > 0,
        F.zip_with(hits, gaps, lambda hit, gap: F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.length(gap).cast("bigint").alias("gap"), hit.alias("hit"))),
    )
    return F.when(F.contains("text", F.lit(rule.has)), found) if rule.has else found


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found (spans with their rule) of the blobs (blob, text) in which a rule finds something."""
    empty = F.lit(None).cast("array<struct<rank:int,kind:string,gap:bigint,hit:string>>")
    every = F.flatten(F.filter(F.array(*[F.coalesce(_matches(r, i), empty) for i, r in enumerate(rules)]), lambda x: x.isNotNull()))
    spread = blobs.select("blob", F.posexplode(every).alias("at", "m")).select("blob", "at", "m.*")
    before = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = spread.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(before))
    counts, key = F.lit(False), F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        whole = F.regexp_extract("hit", rule.pattern, rule.group) if rule.group else F.col("hit")
        counts = F.when(F.col("rank") == i, F.length(whole) >= rule.least).otherwise(counts)
        key = F.when(F.col("rank") == i, rule.key).otherwise(key)
    span = F.struct((F.col("end") - F.length("hit")).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind", key.alias("rule"))
    return ended.where(counts).groupBy("blob").agg(F.collect_list(span).alias("found"))


class Ledger:
    """The tables at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")

    def _append(self, rows: DataFrame, name: str, by: list[str]) -> None:
        writer = rows.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}")

    def record(self, texts: DataFrame, version: int, doc_id: str = "doc_id") -> None:
        """Take the rows of ``texts`` as a version of their paths, and the texts not seen before as a batch of blobs."""
        addressed = texts.select(F.col(doc_id).alias("doc_id"), address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        known = self._read("blobs", BLOBS).select("blob")
        fresh = addressed.select("blob", "text").dropDuplicates(["blob"])
        self._append(fresh.join(known, "blob", "left_anti").withColumn("batch", F.lit(uuid.uuid4().hex)), "blobs", ["batch"])
        self._append(addressed.select("doc_id", "blob").withColumn("version", F.lit(version)), "history", [])  # unpartitioned: an empty one has its columns

    def due(self, rules: tuple[Rule, ...] = RULES) -> dict[tuple[Rule, ...], list[str]]:
        """The batches with rules that haven't scanned them, by those rules; batches are as many as records."""
        done = defaultdict(set)
        for r in self._read("scans", SCANS).select("batch", "rule").distinct().collect():
            done[r.batch].add(r.rule)
        found = defaultdict(list)
        for r in self._read("blobs", BLOBS).select("batch").distinct().orderBy("batch").collect():
            if missing := tuple(x for x in rules if x.key not in done[r.batch]):
                found[missing].append(r.batch)
        return found

    def update(self, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan every pair of blob and rule version that hasn't been, and record it."""
        for missing, batches in self.due(rules).items():
            run = uuid.uuid4().hex
            blobs = self._read("blobs", BLOBS).where(F.col("batch").isin(*batches))
            self._append(scan(blobs.select("blob", "text"), missing).withColumn("run", F.lit(run)), "found", ["run"])
            pairs = self.spark.range(1).select(F.explode(F.array(*map(F.lit, batches))).alias("batch")).select("batch", F.explode(F.array(*[F.lit(r.key) for r in missing])).alias("rule"))
            self._append(pairs.withColumn("run", F.lit(run)), "scans", ["run"])

    def spans(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and its spans by the rules' present versions, from recorded runs."""
        runs = self._read("scans", SCANS).select("run").distinct()
        rank, wanted = F.lit(None).cast("int"), [r.key for r in rules]
        for i, rule in reversed(list(enumerate(rules))):
            rank = F.when(F.col("s.kind") == rule.kind, i).otherwise(rank)
        each = self._read("found", FOUND).join(runs, "run", "left_semi").select("blob", F.explode("found").alias("s")).where(F.col("s.rule").isin(*wanted))
        return each.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("s.start", rank.alias("rank"), "s.end", "s.kind"))).alias("found"))

    def findings(self, rules: tuple[Rule, ...] = RULES, version: int | None = None) -> DataFrame:
        """doc_id, version, blob and the spans for every recorded row, or those of one version."""
        # a written table, not an aggregate, beside a blob that very many paths hold: else Spark doesn't split a skewed join
        found = Scratch(self.spark, "secret-findings").save(self.spans(rules), "found")
        rows = self.spark.read.parquet(f"{self.path}/history")
        rows = rows if version is None else rows.where(F.col("version") == version)
        return rows.join(found, "blob", "left").select("doc_id", "version", "blob", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = Ledger(spark, f"{Scratch(spark, 'secret-ledger').path}/ledger")
    ledger.record(docs, 1)
    ledger.update(BASE_RULES)
    ledger.update(RULES)  # only the rules that are new
    base = [r.kind for r in BASE_RULES]
    of = lambda *kinds: F.filter("found", lambda s: s["kind"].isin(*kinds))
    return ledger.findings(version=1).select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(_written(of(*base)), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )


def _sql_rule(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    whole = f"regexp_extract(hit, '{pattern}', {rule.group})" if rule.group else "hit"
    return f"""
select doc_id, '{rule.kind}' kind, {rank} rank, e - length(hit) s, e from (
    select *, cast(sum(length(gap) + length(hit)) over (partition by doc_id order by i) as bigint) e from (
        select doc_id, unnest(hits) hit, unnest(gaps[1:len(hits)]) gap, generate_subscripts(hits, 1) i from (
            select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') hits, regexp_split_to_array(coalesce(text, ''), '{pattern}') gaps from documents)))
where length({whole}) >= {rule.least}"""


ORACLE_SQL = {
    "op10_secret_ledger": f"""
with f as ({" union all ".join(_sql_rule(r, i) for i, r in enumerate(RULES))}),
     g as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
                  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) spans
           from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from documents d left join g using (doc_id)
"""
}

QUERIES = {"op10_secret_ledger": op10_secret_ledger}
