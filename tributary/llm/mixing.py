"""Mixing sources to target weights by systematic sampling.

Targets fill like water: sources share all words by weight, a source stops at
``most_repeats`` times its own words, and the rest goes to the others by weight.
With the sources in order of cap over weight, the filled ones are a prefix, so one
running sum finds the level.

Every document expects target / source words copies. The expectations, as whole
numbers of 2**-24, are prefix-summed within the source; one offset a source is
added; a document is emitted once for each whole number that its sum crosses. So
it is taken at most ``ceil`` of its expectation, and reruns agree. The order goes by
size class, largest first, so that the sample has documents of every size and the
words taken come near the target.

A source's documents are summed in blocks (size class, hash of the id), and the
blocks' sums are summed in turn, so a source with a third of all rows is spread
over as many tasks as it has blocks; blocks grow in number with the source.

Defined cases: a null or empty text has size 0; a null source is a source of its
own, last in the order; rows with equal id, or none, are documents of their own;
an empty table gives an empty result; a corpus without a word has targets 0 and
takes nothing; other columns are passed on by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.shared import Scratch, table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
UNIT = 1 << 24
BLOCK_ROWS = 50_000
LEAST_SPREAD = 64
SEED = "mix"
_WORD = "[^\\x20\\x09-\\x0D]+"


def _digits(text: Column) -> Column:
    """A whole number of 32 bits from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, source_rows, target. One row a source; sources are as many as a mix has, so one task orders them."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long")
    weighted = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", most_repeats * F.col("source_size"))
    filling = Window.orderBy((F.col("cap").cast("double") / F.col("weight")), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighted.withColumn("level", left.cast("double") / open_weight)
    # the first source that the level at its turn doesn't fill sets the level for it and all after it
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_order", "level"))).over(everything)
    ordered = level.withColumn("cap_order", F.row_number().over(filling)).withColumn("final", final)
    target = F.when(F.col("cap_order") >= F.col("final.cap_order"), F.least(F.col("final.level") * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return ordered.select("source", "source_size", "source_rows", target.alias("target"))


def allot(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source and size."""
    scratch = Scratch(sizes.sparkSession, "mixing")
    targets = scratch.save(source_targets(sizes, weights, most_repeats), "targets")
    digits = F.col("size").cast("string")
    rate = F.coalesce(F.floor(F.col("target") * UNIT / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long")
    spread = F.greatest(F.lit(LEAST_SPREAD), F.col("source_rows").cast("long") / F.lit(BLOCK_ROWS)).cast("long")
    placed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        sizes["*"],
        "source_size",
        "target",
        rate.alias("_rate"),
        (F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")).alias("_class"),
        F.pmod(_digits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), spread).alias("_part"),
    )
    block = ["source", "_class", "_part"]
    sums = placed.groupBy(*block).agg(F.sum("_rate").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy(F.desc("_class"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.shiftright(_digits(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 8)
    starts = sums.select(*[F.col(c).alias(f"b{c}") for c in block], (F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) + offset).alias("_start"))
    inside = Window.partitionBy(*block).orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("_end", F.sum("_rate").over(inside))
    at = (running["source"].eqNullSafe(starts["bsource"])) & (F.col("_class") == F.col("b_class")) & (F.col("_part") == F.col("b_part"))
    end = F.col("_end") + F.col("_start")
    copies = F.shiftright(end, 24) - F.shiftright(end - F.col("_rate"), 24)
    return running.join(starts, at).withColumn("copies", copies).drop("_rate", "_class", "_part", "_end", "_start", *[f"b{c}" for c in block])


def word_count() -> Column:
    return F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(_WORD))).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of each document."""
    return docs.select("doc_id", "source", word_count().alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents, in all their columns, each as often as the mix takes it.

    Copies are joined to texts by id, source and size; repeated rows share theirs in turn.
    """
    sizes = Scratch(docs.sparkSession, "mixing-sizes").save(sized(docs), "sizes")
    taken = allot(sizes, weights, most_repeats, seed)
    key = ["doc_id", "source", "size"]
    counted = taken.groupBy(*key).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    counted = counted.where("_copies > 0").select(*[F.col(c).alias(f"_{c}") for c in key], "_copies", "_rows")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(row.alias("row"), word_count().alias("own_size"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_doc_id")) & F.col("row.source").eqNullSafe(F.col("_source")) & (F.col("own_size") == F.col("_size"))
    joined = tagged.join(counted, same)
    single = joined.where("_rows = 1").select("row", F.col("_copies").alias("times"))
    turn = F.row_number().over(Window.partitionBy("_doc_id", "_source", "_size").orderBy(F.xxhash64("row.text")))
    share = lambda k: F.floor(F.col("_copies") * k / F.col("_rows"))
    several = joined.where("_rows > 1").withColumn("turn", turn).select("row", (share(F.col("turn")) - share(F.col("turn") - 1)).alias("times"))
    dealt = single.unionByName(several).where("times > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = Scratch(spark, "mixing-sizes").save(sized(table(spark, sf_dir, "documents")), "sizes")
    return allot(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = {
    "op9_source_mixing": f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size from documents),
t as (select source, cast(sum(size) as bigint) source_size, count(*) source_rows from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 k from t),
w as (select *, case k % 3 when 0 then 5 when 1 then 2 else 1 end weight, 3 * source_size cap from r),
o as (select *, row_number() over f cap_order,
             cast((sum(source_size) over () - coalesce(sum(cap) over (f rows between unbounded preceding and 1 preceding), 0)) as double)
             / (sum(weight) over () - coalesce(sum(weight) over (f rows between unbounded preceding and 1 preceding), 0)) lvl
      from w window f as (order by cast(cap as double) / weight, k)),
z as (select min(cap_order) first_open from o where lvl * weight <= cap),
g as (select source, source_size, source_rows,
             case when cap_order >= first_open then least((select lvl from o where cap_order = first_open) * weight, cast(cap as double)) else cast(cap as double) end target
      from o, z),
p as (select d.*, source_size, target, cast(coalesce(floor(target * {UNIT} / nullif(source_size, 0)), 0) as bigint) rate,
             length(cast(size as varchar)) * 100 + cast(rpad(substr(cast(size as varchar), 1, 2), 2, '0') as int) class,
             cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) % greatest({LEAST_SPREAD}, cast(floor(source_rows / {BLOCK_ROWS}.0) as bigint)) part,
             cast(('0x' || substr(md5('{SEED}/' || coalesce(d.source, '')), 1, 8)) as bigint) >> 8 shift
      from d join g on d.source is not distinct from g.source),
e as (select *, cast(sum(rate) over (partition by source order by class desc, part, doc_id, size rows unbounded preceding) + shift as bigint) e from p)
select doc_id, size, source_size, target, cast(((e >> 24) - ((e - rate) >> 24)) * size as bigint) taken from e
"""
}

QUERIES = {"op9_source_mixing": op9_source_mixing}
