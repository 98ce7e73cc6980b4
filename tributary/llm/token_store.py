"""Token ids in a content-addressed binary store.

File format, version 2, four Parquet tables in one folder, written in this order:

* ``chunks``: key (16-byte BLAKE2b of the payload), payload. A payload is a width
  byte (2 or 4) and ids as little-endian unsigned integers of that width. Each
  distinct chunk is stored once.
* ``recipes``, in ascending doc_id order: doc_id, start (ids before it), n_tokens,
  chunks (hashes in order), root (Merkle root over them), part.
* ``manifest``: one row a part of ``recipes``: part, first_start, n_docs, n_tokens, root
  (Merkle root over its documents' roots, starts, sizes and ids).
* ``total``: one row: n_parts, n_docs, n_tokens, root (Merkle root over the parts' roots).
  It is written last, so a store without it was never finished.

A document's ids, with the end id, are cut where a rolling hash over the last eight
ids has ``MASK`` zero bits, at 64 to 1,024 ids, so documents that share passages
share chunks. Reading checks every payload against its hash, every recipe against
its root, every part against the manifest and the manifest against the total, and
fails on any difference: a chunk, recipe or manifest row that is changed, missing or too many.

Defined cases: a null or empty text is the end id alone; rows with equal doc_id
are documents of their own, in any order among themselves; a null doc_id sorts
first; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.pieces_cache import piece_cache
from tributary.llm.shared import Scratch, in_batches, release, table
from tributary.llm.shingles import U64, mix, pieces

END_ID = 2
WINDOW = 8
MASK = U64(0xFF)
LEAST, MOST = 64, 1024
PIECE_BYTES = 1 << 19


def cut_points(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    sums = np.cumsum(mix(ids.astype(U64) + U64(1)))
    rolled = sums[WINDOW - 1 :].copy()
    rolled[1:] -= sums[:-WINDOW]
    marks = np.flatnonzero((mix(rolled) & MASK) == 0) + WINDOW
    ends, at = [], 0
    while n - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def pack(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype=f"<u{payload[0]}", offset=1).astype("<u4")


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    """The root of a binary tree over the hashes; a level's odd last one moves up as it is."""
    level = [hashlib.blake2b(b"\0" + h, digest_size=16).digest() for h in hashes] or [b"\0" * 16]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def crc_join(a: int, b: int, n: int) -> int:
    """The CRC-32 of two byte strings put together, from theirs and the second one's length."""
    zeros = b"\0" * n
    return zlib.crc32(zeros, a) ^ b ^ zlib.crc32(zeros)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, encode_special: bool = True) -> DataFrame:
    """Rows of chunks (key, payload) and of recipes (key, doc_id, n_tokens, hashes), told apart by ``kind``.

    A chunk that a task meets again isn't sent again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "key", "payload", "doc_id", "n_tokens", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, sent = piece_cache(tokenizer, encode_special), set()
        task, serial = TaskContext.get().partitionId(), 0
        for rows, data, offsets in pieces(batches, "text", PIECE_BYTES):
            ids, first = cache.encode(data, offsets)
            chunks: dict[bytes, bytes] = {}
            recipes, sizes = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                recipe, at = [], 0
                for end in cut_points(own):
                    payload = pack(own[at:end])
                    h = address(payload)
                    recipe.append(h)
                    if h not in sent:
                        sent.add(h)
                        chunks[h] = payload
                    at = end
                recipes.append(recipe)
                sizes.append(len(own))
            n, m = len(chunks), len(recipes)
            ids_column = rows.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(["chunk"] * n, pa.string()), pa.array(list(chunks), pa.binary()), pa.array(list(chunks.values()), pa.binary()), pa.nulls(n, ids_column.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary()))],
                names,
            )
            keys = [struct.pack(">QQ", task, serial + i) for i in range(m)]  # the same if the task runs again
            serial += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(["recipe"] * m, pa.string()), pa.array(keys, pa.binary()), pa.nulls(m, pa.binary()), ids_column, pa.array(sizes, pa.int64()), pa.array(recipes, pa.list_(pa.binary()))],
                names,
            )

    return in_batches(docs.select("doc_id", "text"), run, f"kind string, key binary, payload binary, doc_id {kind}, n_tokens long, hashes array<binary>")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each recipe's Merkle root and its start within the partition, whose rows come in order."""
    start = 0
    for batch in batches:
        roots = [merkle_root(x) for x in batch.column("hashes").to_pylist()]
        sizes = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        until = start + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(until - sizes, pa.int64()), pa.array(sizes, pa.int64()), batch.column("hashes"), pa.array(roots, pa.binary()), batch.column("part")],
            ["doc_id", "local_start", "n_tokens", "chunks", "root", "part"],
        )
        start = int(until[-1]) if len(until) else start


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Recipes in order -> one row a run of a part."""
    for part, rows in _by_part(batches):
        yield pd.DataFrame({"part": [part], "n_docs": [len(rows)], "n_tokens": [sum(n for n, _ in rows)], "root": [merkle_root([r for _, r in rows])]})


def _by_part(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    part, rows = None, []
    for batch in batches:
        for p, n, leaf in zip(batch["part"], batch["n_tokens"], batch["leaf"], strict=True):
            if p != part and rows:
                yield part, rows
                rows = []
            part = p
            rows.append((n, leaf.encode()))
    if rows:
        yield part, rows


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encode_special: bool = True) -> None:
    """Encode the texts and write the four tables under ``path``.

    encode_special: special tokens in texts are encoded as other text, not as the tokenizer's
    library does by default.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    rows = encoded(docs, tokenizer, end_id, encode_special)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one shuffle: chunks meet their equals, recipes come along
    met = rows.repartition(parts, "key").dropDuplicates(["key"])
    split = scratch.save(met, "encoded", partition_by=["kind"])
    split.where("kind = 'chunk'").select("key", "payload").write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = split.where("kind = 'recipe'").select("doc_id", "n_tokens", "hashes", "key")
    ordered = recipes.repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("part", F.spark_partition_id())
    kind = recipes.schema["doc_id"].dataType.simpleString()
    placed = in_batches(ordered, _placed, f"doc_id {kind}, local_start long, n_tokens long, chunks array<binary>, root binary, part int")
    local = scratch.save(placed, "local", partition_by=["part"])
    scratch.drop("encoded")
    release(spark)
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("first_start"))
    starts = scratch.save(starts, "starts")
    final = local.join(starts, "part").select("doc_id", (F.col("first_start") + F.col("local_start")).alias("start"), "n_tokens", "chunks", "root", "part", "first_start")
    final = final.repartition(parts, "part").sortWithinPartitions("part", "start")
    final.write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.drop("local")
    release(spark)
    _manifest(read_recipes(spark, path)).write.parquet(f"{path}/manifest")
    _total(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/total")


def _manifest(recipes: DataFrame) -> DataFrame:
    leaf = F.concat_ws(":", F.hex("root"), "start", "n_tokens", F.coalesce(F.hex(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit("null")))
    ordered = recipes.repartition("part").sortWithinPartitions("part", "start").select("part", "n_tokens", leaf.alias("leaf"))
    rooted = ordered.mapInPandas(_roots, "part int, n_docs long, n_tokens long, root binary")
    firsts = recipes.groupBy("part").agg(F.min("first_start").alias("first_start"))
    return rooted.join(firsts, "part")


def _total(manifest: DataFrame) -> DataFrame:
    """One row over the manifest's rows, of which there are as many as parts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["part", "n_docs", "n_tokens", "root"]), *batches]).sort_values("part")
        yield pd.DataFrame({"n_parts": [len(rows)], "n_docs": [int(rows["n_docs"].sum())], "n_tokens": [int(rows["n_tokens"].sum())], "root": [merkle_root(list(rows["root"]))]})

    return manifest.select("part", "n_docs", "n_tokens", "root").coalesce(1).mapInPandas(run, "n_parts long, n_docs long, n_tokens long, root binary")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, payload binary").parquet(f"{path}/chunks")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads -> number and CRC-32 of their ids; fails where a payload isn't what its hash says."""
    for batch in batches:
        sizes, crcs = [], []
        for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if address(payload) != key:
                raise ValueError(f"chunk {key.hex()} has other content")
            raw = unpack(payload).tobytes()
            sizes.append(len(raw) // 4)
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["key", "n", "crc"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes with their chunks' sizes and sums -> size and CRC-32 of the document; fails on a difference."""
    for batch in batches:
        crcs = []
        for start, n_tokens, chunks, root, parts in zip(*(batch.column(c).to_pylist() for c in ("start", "n_tokens", "chunks", "root", "parts")), strict=True):
            crc, n = 0, 0
            for p in sorted(parts or [], key=lambda x: x["at"]):
                if p["n"] is None:
                    raise ValueError(f"a chunk of the document at {start} is missing")
                crc, n = crc_join(crc, p["crc"], 4 * p["n"]), n + p["n"]
            if len(parts or []) != len(chunks) or n != n_tokens or merkle_root(chunks) != root:
                raise ValueError(f"the document at {start} isn't as its recipe says")
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def verify_store(spark: SparkSession, path: str) -> None:
    """Compare recipes, manifest and total with each other; fails on any difference."""
    columns = ["part", "n_docs", "n_tokens", "root", "first_start"]
    said = spark.read.parquet(f"{path}/manifest").select(columns)
    found = _manifest(read_recipes(spark, path)).select(columns)
    if not found.exceptAll(said).isEmpty() or not said.exceptAll(found).isEmpty():
        raise ValueError(f"{path}: recipes and manifest differ")
    if spark.read.parquet(f"{path}/total").collect() != _total(said).collect():
        raise ValueError(f"{path}: manifest and total differ")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    if not said.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).where("before <> first_start").isEmpty():
        raise ValueError(f"{path}: parts don't follow each other")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    Each stored chunk is read and checked once; a document's CRC-32 is put together
    from its chunks', so no id is shuffled. A recipe whose chunks are missing fails.
    """
    verify_store(spark, path)
    recipes = read_recipes(spark, path)
    sums = in_batches(read_chunks(spark, path), _checked, "key binary, n long, crc long")
    used = recipes.select("start", F.posexplode("chunks").alias("at", "key"))
    parts = used.join(sums, "key", "left").groupBy("start").agg(F.collect_list(F.struct("at", "n", "crc")).alias("parts"))
    joined = recipes.join(parts, "start", "left").select("doc_id", "start", "n_tokens", "chunks", "root", "parts")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return in_batches(joined, _folded, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of long) of each document, put together from its chunks; checked like :func:`read_digests`."""
    verify_store(spark, path)
    recipes = read_recipes(spark, path)
    used = recipes.select("start", F.posexplode("chunks").alias("at", "key"))
    parts = used.join(read_chunks(spark, path), "key", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "key", "payload"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for start, chunks, root, n, parts in zip(*(batch.column(c).to_pylist() for c in ("start", "chunks", "root", "n_tokens", "parts")), strict=True):
                if merkle_root(chunks) != root or any(p["payload"] is None or address(p["payload"]) != p["key"] for p in parts or []):
                    raise ValueError(f"the document at {start} isn't as its recipe says")
                own = np.concatenate([np.empty(0, dtype="<u4"), *(unpack(p["payload"]) for p in parts or [])]).astype(np.int64)
                if len(own) != n:
                    raise ValueError(f"the document at {start} has {len(own)} ids, not {n}")
                ids.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return in_batches(recipes.join(parts, "start", "left").select("doc_id", "start", "n_tokens", "chunks", "root", "parts"), run, f"doc_id {kind}, start long, ids array<long>")


def tokens_of(docs: DataFrame) -> DataFrame:
    """Write the documents to a new store in the shared folder and read their digests back; ids are the library's by default."""
    import public_tokenizers

    spark = docs.sparkSession
    path = f"{Scratch(spark, 'token-files').path}/store"
    write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), encode_special=False)
    return read_digests(spark, path)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_store": op2_token_store}
