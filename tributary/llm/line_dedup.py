"""Line dedup over the whole corpus.

Texts are exploded into normalised lines, which are hashed to 128 bits. For each
hash the distinct documents are counted; where a hash reaches the threshold, its
lines go from all documents but the one with the smallest id. Every document is
then reassembled from its remaining lines by position.

A document hands in each of its hashes once, so the count per hash is pre-summed
before its shuffle, and what comes back to a document is at most its own hashes.
A hash that a third of the documents hold is a hot key only in a join that Spark
splits (adaptive skew join); its rows never meet in one task.

Defined cases: a null or empty text is one empty line; keys under ``min_chars``
code points always stay; repeated rows with one id count as one document and are
treated alike; rows with a null id count for nothing and stay whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.shared import Scratch, in_batches, table
from tributary.llm.shingles import pieces

MIN_CHARS = 10
MIN_DOCS = 2
_EDGE = b" \t\n\v\f\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; None for a key that is too short."""
    key = line.strip(_EDGE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and line: each distinct line hash of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            owner, found = [], []
            raw = data.tobytes()
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                keys = {line_hash(x, min_chars) for x in set(raw[a:b].split(b"\n"))} - {None}
                found += keys
                owner += [d] * len(keys)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(found, pa.binary())], ["doc_id", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), run, f"doc_id {kind}, line binary")


def repeated_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """line and its first document, for the lines in at least ``min_docs`` documents.

    For two documents the smallest and the largest id tell, so that the counts are
    summed before the shuffle whatever the key.
    """
    first = F.min("doc_id").alias("first_doc")
    if min_docs <= 2:
        found = keys.groupBy("line").agg(first, F.max("doc_id").alias("last_doc"))
        return found.where(F.col("first_doc") < F.col("last_doc") if min_docs == 2 else F.lit(True)).select("line", "first_doc")
    found = keys.groupBy("line").agg(first, F.count_distinct("doc_id").alias("n_docs"))
    return found.where(F.col("n_docs") >= min_docs).select("line", "first_doc")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and the hashes of the lines that it loses."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    keys = scratch.save(line_keys(docs, min_chars), "keys")  # read twice, hashed once
    # a written table, not an aggregate, beside the hot keys' exchange: else Spark doesn't split a skewed join
    repeated = scratch.save(repeated_lines(keys, min_docs), "repeated")
    lost = keys.join(repeated, "line").where(F.col("doc_id") > F.col("first_doc"))
    return lost.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line").alias("_lost"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (its remaining lines), n_lines, n_dropped for each document."""
    lost = dropped_lines(docs, min_chars, min_docs)
    joined = docs.select("doc_id", "text").join(lost, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "_lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            texts, counts, dropped = [], [], []
            raw = data.tobytes()
            for a, b, lost in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column("_lost").to_pylist(), strict=True):
                lines = raw[a:b].split(b"\n")
                kept = lines
                if lost:
                    gone = set(lost)
                    kept = [x for x in lines if line_hash(x, min_chars) not in gone]
                texts.append(b"\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(joined, run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op4_line_dedup": """
with l as (select doc_id, p, line,
                  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
           from (select doc_id, unnest(s) line, generate_subscripts(s, 1) p
                 from (select doc_id, string_split(coalesce(text, ''), chr(10)) s from documents))),
     r as (select k, min(doc_id) first_doc from l where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
     m as (select l.*, coalesce(l.doc_id > r.first_doc, false) gone from l left join r using (k))
select doc_id, cast(count(*) as bigint) n_lines, cast(count(*) filter (gone) as bigint) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) kept_sha256
from m group by doc_id
"""
}

QUERIES = {"op4_line_dedup": op4_line_dedup}
