"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of n shingles is in a document if the document has at least
``ceil(containment * n)`` of them. Items are partitioned by size, class c holding those of
2**(c-1) to 2**c - 1 shingles. A class has one signature length: its items keep their
bottom-k MinHash for the k that its largest size needs, one more than such an item may
miss (or all its hashes if it has fewer). Each item then has its threshold: of its k
hashes a document that contains it misses at most as many as the item may miss in all,
so it has the rest. Every class is probed with its own table and thresholds; that loses
nothing, however long the document. Every candidate is verified by the exact shingles,
as words.

Items of up to ``INDEX_BYTES`` of text are indexed in memory and go to the executors with
the task; documents are then only mapped over. More items are searched as tables: the
distinct shingles of the documents that pass a bit filter of the items' hashes (of a fixed
size) meet the items' shingles in a join, on hash and words, and are counted for the
signature and for the whole item. Both ways read the texts once, shuffle none of them, and
find the same.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of
fewer than five words has one shingle, the whole sequence, and so is found only
in a document of the same few words; null or empty items and texts match
nothing; items with equal text are reported each; repeated documents are
reported each; null ids are kept as they are, and ids have any type; an empty table of items
or documents gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tributary.llm.shared import Scratch, in_batches, table
from tributary.llm.shingles import U64, WIDTH, draw_keys, mix, one_text, pieces, short_run, windows, words

CONTAINMENT = 75  # per cent of an item's shingles
INDEX_BYTES = 8 << 20  # of item texts, with 64 bytes more for each, that are indexed in memory
_FILTER_BITS = 20
_SALT = U64(0x632BE59BD9B4E019)


def exact_shingles(raw: bytes, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, as tuples of lower-cased words."""
    found = raw.lower().split()  # bytes: A-Z only, and the six ASCII space characters
    if len(found) < width:
        return {tuple(found)} if found else set()
    return set(zip(*(found[j:] for j in range(width)), strict=False))


def item_hashes(text: str | None, keys: np.ndarray) -> np.ndarray:
    """An item's distinct shingle hashes, the smallest MinHash first."""
    own, _, _, _ = words(*one_text(text), keys)
    if not len(own):
        return own
    runs = np.unique(windows(own, WIDTH, keys) if len(own) >= WIDTH else short_run(own, keys))
    return runs[np.argsort(mix(runs ^ _SALT), kind="stable")]


def signature(n: int, percent: int) -> tuple[int, int, int]:
    """The size class of an item of n shingles, the hashes of its signature, and how many of them a document must have."""
    spare = lambda m: m - math.ceil(percent * m / 100)
    size_class = n.bit_length()
    length = min(n, spare((1 << size_class) - 1) + 1)
    return size_class, length, length - spare(n)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)


class Partition:
    """The signatures of one size class."""

    def __init__(self) -> None:
        self.holders: dict[int, list[int]] = defaultdict(list)

    def seal(self) -> None:
        self.keys = np.array(sorted(self.holders), dtype=U64)
        self.posts = [self.holders[k] for k in self.keys.tolist()]
        del self.holders

    def probe(self, documents: np.ndarray, hashes: np.ndarray, need: list[int]) -> set[tuple[int, int]]:
        """(document, item) with as many distinct hashes in common as the item asks for."""
        slots = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[slots] == hashes
        met = np.unique(np.stack([documents[known], slots[known]], axis=1), axis=0)
        shared = Counter((d, i) for d, slot in met.tolist() for i in self.posts[slot])
        return {pair for pair, n in shared.items() if n >= need[pair[1]]}


class ItemIndex:
    """Signatures of items by size class, behind one bit filter."""

    def __init__(self, items: list[tuple[object, str | None]], keys: np.ndarray, percent: int = CONTAINMENT):
        self.ids: list[object] = []
        self.shingles: list[set[tuple[bytes, ...]]] = []
        self.need: list[int] = []
        self.percent, self.keys = percent, keys
        self.partitions: dict[int, Partition] = defaultdict(Partition)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for item, text in items:
            hashes = item_hashes(text, keys)
            if not len(hashes):
                continue
            size_class, length, need = signature(len(hashes), percent)
            for h in hashes[:length].tolist():
                self.partitions[size_class].holders[h].append(len(self.ids))
            self.filter[_bits(hashes[:length])] = True
            self.ids.append(item)
            self.need.append(need)
            self.shingles.append(exact_shingles((text or "").encode()))
        for p in self.partitions.values():
            p.seal()

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Verified hits: document -> (item, shingles it shares with the document)."""
        candidates: dict[int, set[int]] = defaultdict(set)
        documents, hashes, _ = probed(data, offsets, self.keys, self.filter)
        for p in self.partitions.values():
            for document, item in p.probe(documents, hashes, self.need):
                candidates[document].add(item)
        hits: dict[int, list[tuple[int, int]]] = {}
        for document, items in sorted(candidates.items()):
            own = exact_shingles(data[offsets[document] : offsets[document + 1]].tobytes())
            shared = [(i, len(self.shingles[i] & own)) for i in sorted(items)]
            if kept := [(i, n) for i, n in shared if 100 * n >= self.percent * len(self.shingles[i])]:
                hits[document] = kept
        return hits


def probed(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The shingles of texts that pass a bit filter: their documents, hashes and places (bytes from, to)."""
    hashes, starts, ends, first = words(data, offsets, keys)
    runs = windows(hashes, WIDTH, keys)
    at = np.flatnonzero(bits[_bits(runs)])
    owner = np.searchsorted(first, at, side="right") - 1
    inside = at + WIDTH <= first[owner + 1]
    at, owner = at[inside], owner[inside]
    found, of = [runs[at]], [owner]
    places = list(zip(starts[at].tolist(), ends[at + WIDTH - 1].tolist(), strict=True))
    sizes = np.diff(first)
    for document in np.flatnonzero((sizes > 0) & (sizes < WIDTH)).tolist():
        run = short_run(hashes[first[document] : first[document + 1]], keys)
        if bits[_bits(run)][0]:
            found.append(run)
            of.append(np.array([document]))
            places.append((int(starts[first[document]]), int(ends[first[document + 1] - 1])))
    return np.concatenate(of), np.concatenate(found), places


def _in_memory(items: DataFrame, limit: int) -> bool:
    size = items.select(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0)).alias("n")).first()["n"]
    return size <= limit


def search(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared for each item found in a document."""
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("n_item_shingles", T.LongType()), T.StructField("n_shared", T.LongType())])
    if not _in_memory(items, index_bytes):
        found, numbered = search_tables(docs.select("doc_id", "text"), items, percent)
        ids = numbered.select("row", "doc_id")
        return ids.join(found, "row").select(schema.names)
    index = ItemIndex([(r[0], r[1]) for r in items.select("item_id", "text").collect()], draw_keys(), percent)
    kind = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            hits = [(d, i, n) for d, kept in index.matches(data, offsets).items() for i, n in kept]
            if hits:
                d, i, n = (list(x) for x in zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(d)), pa.array([index.ids[x] for x in i], kind), pa.array([len(index.shingles[x]) for x in i], pa.int64()), pa.array(n, pa.int64())],
                    schema.names,
                )

    return in_batches(docs.select("doc_id", "text"), run, schema)


def _shingle_rows(batches: Iterator[pa.RecordBatch], keys: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Items -> a row for each shingle: hash, words, whether it is in the signature, and the item's size, class and threshold."""
    for batch in batches:
        for number, item, text in zip(batch.column("item").to_pylist(), batch.column("item_id"), batch.column("text").to_pylist(), strict=True):
            hashes = item_hashes(text, keys)
            if not len(hashes):
                continue
            size_class, length, need = signature(len(hashes), percent)
            spoken = {h: b" ".join(s) for s in exact_shingles(text.encode()) for h in item_hashes((b" ".join(s)).decode(), keys).tolist()}
            n = len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array([item.as_py()] * n, item.type), pa.array(hashes.view(np.int64)), pa.array([spoken[h] for h in hashes.tolist()], pa.binary()),
                 pa.array(np.arange(n) < length), *(pa.array([x] * n, pa.int64()) for x in (size_class, need, n))],
                ["item", "item_id", "hash", "words", "signed", "size_class", "need", "n_item_shingles"],
            )


def search_tables(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """(row, item_id, n_item_shingles, n_shared) of the items found, and the documents with their rows' numbers; any number of items."""
    scratch, keys = Scratch(docs.sparkSession, "decontaminate"), draw_keys()
    schema = T.StructType(
        [T.StructField("item", T.LongType()), items.schema["item_id"], T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("signed", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("size_class", "need", "n_item_shingles")]
    )
    numbered_items = scratch.save(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    indexed = scratch.save(in_batches(numbered_items, lambda batches: _shingle_rows(batches, keys, percent), schema), "index", partition_by=["size_class"])
    taken = indexed.select(F.shiftrightunsigned("hash", 64 - _FILTER_BITS).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)  # 1 << _FILTER_BITS numbers at most
    bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bits[taken] = True
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            documents, hashes, places = probed(data, offsets, keys, bits)
            spoken = [b" ".join(data[a:b].tobytes().lower().split()) for a, b in places]
            yield pa.RecordBatch.from_arrays([rows.column("row").take(pa.array(documents)), pa.array(hashes.view(np.int64)), pa.array(spoken, pa.binary())], ["row", "hash", "words"])

    numbered = docs.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256))
    met = scratch.save(in_batches(numbered.select("row", "text"), run, "row string, hash long, words binary").distinct(), "met")
    shared = met.join(indexed, ["hash", "words"]).groupBy("row", "item").agg(
        F.count("*").alias("n_shared"), F.count_if("signed").alias("n_signed"), F.first("need").alias("need"), F.first("n_item_shingles").alias("n_item_shingles"), F.first("item_id").alias("item_id")
    )
    found = shared.where(f"n_signed >= need and 100 * n_shared >= {percent} * n_item_shingles")
    return scratch.save(found.select("row", "item_id", "n_item_shingles", "n_shared"), "found"), numbered


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents, in all their columns, that contain no item. With an index in memory a map over the texts: nothing is shuffled."""
    if not _in_memory(items, index_bytes):
        found, _ = search_tables(docs.select("text"), items, percent)
        row = "row"
        while row in docs.columns:
            row = f"_{row}"
        return docs.withColumn(row, F.sha2(F.coalesce("text", F.lit("")), 256)).join(found.select(F.col("row").alias(row)).distinct(), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    index = ItemIndex([(r[0], r[1]) for r in items.select("item_id", "text").collect()], draw_keys(), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            clean = np.ones(rows.num_rows, dtype=bool)
            clean[list(index.matches(data, offsets))] = False
            yield rows if clean.all() else rows.filter(pa.array(clean))

    return in_batches(docs, run, docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """
    select {id}, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    when len(w) > 0 then ['<' || array_to_string(w, ' ')] else [] end) s
    from (select {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from {table})
"""

ORACLE_SQL = {
    "op5_benchmark_decontamination": f"""
with d as ({_SHINGLES.format(id="doc_id", table="documents")}),
     b as ({_SHINGLES.format(id="item_id", table="benchmark")}),
     bs as (select item_id, len(s) n, unnest(s) g from b),
     ds as (select doc_id, unnest(s) g from d)
select doc_id, item_id, cast(any_value(n) as bigint) n_item_shingles, cast(count(*) as bigint) n_shared
from bs join ds using (g) group by doc_id, item_id having 100 * count(*) >= 75 * any_value(n)
"""
}

QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
