"""Chat formatting into a prefix tree of turns.

Conversations that begin with the same turns share them: a node is a distinct sequence
of turns from the start, and each node's text is emitted once. Nodes are laid out
depth-first in one global sequence of units (code points, or token ids if a tokenizer
is given). Each has its interval there, the position ids of its units (which go on
along its own conversation), the part under the loss mask, and the intervals that
its units attend to: its ancestors' and its own, adjoining ones joined.

The layout comes from sorting: with conversations in order of their paths, a node
belongs to the first conversation that has it, so nodes in order of that conversation and
their depth are in depth-first order. Nothing gathers a tree in one task, so a first
turn that a third of all conversations share costs no more than others.

The query's units are the token ids of a public tokenizer: head, text and tail of a turn are
encoded apart, so no token straddles the loss mask, and what the tree says of a
conversation is decoded from its ids, to the character.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed for each turn. A backslash before ``<turn``, ``</turn`` and
backslashes in texts, and before ``<``, ``>`` and backslashes in roles, makes it reversible.

Defined cases: a null role or text is empty; turns with equal numbers are ordered by
role and text, null numbers come first; each row with a null conv_id is a conversation of its own;
repeated rows are turns of their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.pieces_cache import byte_table, piece_cache
from tributary.llm.shared import Scratch, in_batches, table

LOSS_ROLE = "assistant"
PROBE = "\\### Assistant: </turn> ok"
_IN_ROLE = re.compile(r"[\\<>]")
_IN_TEXT = re.compile(r"\\|<(?=/?turn)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"<turn ((?:\\.|[^\\>])*)>", re.S)
_TAIL = re.compile(r"\\.|</turn>\n", re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where in it the turn's own text starts and ends."""
    head = f"<turn {_IN_ROLE.sub(lambda m: chr(92) + m[0], role)}>"
    body = _IN_TEXT.sub(lambda m: chr(92) + m[0], text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the interval of the escaped text, of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        if head is None:
            raise ValueError("a turn's head is missing")
        end = next((m for m in _TAIL.finditer(formatted, head.end()) if m[0][0] == "<"), None)
        if end is None:
            raise ValueError("a turn's end is missing")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end.start()]), head.end(), end.start()))
        at = end.end()
    return turns


def _id(parent: bytes, role: str, text: str) -> bytes:
    r, t = role.encode(), text.encode()
    return hashlib.blake2b(parent + len(r).to_bytes(8, "big") + r + t, digest_size=16).digest()


_NODE = "node binary, parent binary, depth int, position long, n_units long, loss_start long, loss_end long, segment string, ids array<int>"


def conversations(rows: DataFrame, loss_role: str = LOSS_ROLE, tokenizer: str | None = None) -> DataFrame:
    """conv_id and the array of its nodes from the first turn to the last."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ided = rows.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("turns"))
    grouped = ided.unionByName(alone)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            talks = batch.column("turns").to_pylist()
            formatted = [[format_turn(t["role"], t["text"]) for t in turns] for turns in talks]
            if tokenizer:  # head, text and tail apart, so that units never straddle the loss mask
                pieces = [x.encode() for turns in formatted for segment, a, b in turns for x in (segment[:a], segment[a:b], segment[b:])]
                every, first = piece_cache(tokenizer).encode(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum([0, *map(len, pieces)]))
                first = first.tolist()
            at = 0
            for turns, segments in zip(talks, formatted, strict=True):
                path, parent, position = [], b"", 0
                for depth, (t, (segment, a, b)) in enumerate(zip(turns, segments, strict=True)):
                    ids = None
                    if tokenizer:
                        ids, a, b = every[first[at] : first[at + 3]], first[at + 1] - first[at], first[at + 2] - first[at]
                        at += 3
                    n = len(segment) if ids is None else len(ids)
                    node = _id(parent, t["role"], t["text"])
                    masked = t["role"] == loss_role
                    path.append({"node": node, "parent": parent, "depth": depth, "position": position, "n_units": n, "loss_start": a if masked else 0, "loss_end": b if masked else 0, "segment": segment, "ids": ids})
                    parent, position = node, position + n
                paths.append(path)
            fields = pa.struct([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("position", pa.int64()), ("n_units", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("segment", pa.string()), ("ids", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.list_(fields))], ["conv_id", "nodes"])

    struct = ", ".join(x.replace(" ", ": ", 1) for x in _NODE.split(", "))
    return in_batches(grouped, run, f"conv_id {kind}, nodes array<struct<{struct}>>")


def _joined(intervals: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _attending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths with their nodes' intervals -> the intervals that each node first met here attends to."""
    for batch in batches:
        nodes, attends = [], []
        for rank, path in zip(batch.column("rank").to_pylist(), batch.column("path").to_pylist(), strict=True):
            so_far: list[tuple[int, int]] = []
            for n in path:
                if so_far and so_far[-1][1] == n["start"]:
                    so_far[-1] = (so_far[-1][0], n["end"])
                else:
                    so_far.append((n["start"], n["end"]))
                if n["first"] == rank:
                    nodes.append(n["node"])
                    attends.append([{"start": a, "end": b} for a, b in so_far])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(attends, _INTERVALS)], ["node", "attends"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place within its partition, in units and in rows."""
    units = rows = 0
    for batch in batches:
        sizes = batch.column("n_units").to_pylist() if "n_units" in batch.schema.names else [0] * batch.num_rows
        starts = []
        for n in sizes:
            starts.append(units)
            units += n
        numbers = list(range(rows, rows + batch.num_rows))
        rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), pa.array(numbers, pa.int64())], [*batch.schema.names, "local_start", "local_row"])


def _ordered(df: DataFrame, scratch: Scratch, name: str, by: list[str]) -> DataFrame:
    """The rows in global order, with part, local_start and local_row, as a written table."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return scratch.save(in_batches(dealt, _local, f"{schema}, local_start long, local_row long"), name)


def write_tree(rows: DataFrame, path: str, loss_role: str = LOSS_ROLE, tokenizer: str | None = None) -> None:
    """Write ``nodes`` and ``leaves`` under ``path``.

    nodes: node, parent, depth, start, end (its interval), position (of its first unit;
    the others count on), loss_start, loss_end (units from its start), segment, ids, attends.
    leaves: conv_id, path (node ids), attends (the intervals that make the conversation).
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "chat-tree")
    built = conversations(rows, loss_role, tokenizer).withColumn("path", F.transform("nodes", lambda n: n["node"]))
    convs = _ordered(built, scratch, "conversations", ["path", "conv_id"]).withColumn("rank", F.col("part").cast("long") * F.lit(1 << 40) + F.col("local_row"))
    met = convs.select("rank", F.explode("nodes").alias("n")).select("rank", "n.*")
    # the first conversation's row of each node; all its rows are alike but for the rank
    first = met.groupBy("node").agg(F.min("rank").alias("first"), *[F.first(c).alias(c) for c in ("parent", "depth", "position", "n_units", "loss_start", "loss_end", "segment", "ids")])
    laid = _ordered(first, scratch, "nodes", ["first", "depth"])
    sizes = laid.groupBy("part").agg(F.sum("n_units").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    start = F.col("offset") + F.col("local_start")
    placed = scratch.save(laid.join(offsets, F.col("part") == F.col("of_part")).withColumn("start", start).withColumn("end", start + F.col("n_units")).drop("of_part", "offset", "local_start", "local_row", "part"), "placed")
    steps = convs.select("rank", F.posexplode("path").alias("at", "node")).join(placed.select("node", "start", "end", "first"), "node")
    paths = steps.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("at", "node", "start", "end", "first"))).alias("path"))
    paths = scratch.save(paths, "paths")
    attends = in_batches(paths, _attending, "node binary, attends array<struct<start: long, end: long>>")
    placed.join(attends, "node").drop("first").write.parquet(f"{path}/nodes")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([[n["node"] for n in p] for p in found], pa.list_(pa.binary())), pa.array([_joined([(n["start"], n["end"]) for n in p]) for p in found], _INTERVALS)],
                ["conv_id", "path", "attends"],
            )

    kind = rows.schema["conv_id"].dataType.simpleString()
    in_batches(convs.select("conv_id", "rank").join(paths, "rank").select("conv_id", "path"), leaves, f"conv_id {kind}, path array<binary>, attends array<struct<start: long, end: long>>").write.parquet(f"{path}/leaves")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, and its nodes' segments or ids with what of them is under the loss mask, in order."""
    nodes = spark.read.parquet(f"{path}/nodes").select("node", "start", "segment", "ids", "loss_start", "loss_end")
    leaves = spark.read.parquet(f"{path}/leaves").withColumn("leaf", F.monotonically_increasing_id())
    # conversations with null or equal ids are told apart by the row's own number, which a written table keeps
    steps = leaves.select("conv_id", "leaf", F.explode("path").alias("node")).join(nodes, "node")
    return steps.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "ids", "loss_start", "loss_end"))).alias("parts"))


def digests(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """What the stored tree says of each conversation; with a tokenizer, read from the token ids alone."""
    parts = read_conversations(spark, path)
    kind = parts.schema["conv_id"].dataType.simpleString()
    slim = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), (F.lit(None).cast("string") if tokenizer else p["segment"]).alias("segment"), p["ids"].alias("ids"), p["loss_start"].alias("loss_start"), p["loss_end"].alias("loss_end")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        table = byte_table(tokenizer) if tokenizer else []
        decode = lambda ids: b"".join([table[i] for i in ids]).decode()
        for batch in batches:
            rows = []
            for conv, found in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if tokenizer:
                    formatted = "".join(decode(p["ids"]) for p in found)
                    loss = "".join(unescape(decode(p["ids"][p["loss_start"] : p["loss_end"]])) for p in found)
                else:
                    formatted = "".join(p["segment"] for p in found)
                    loss = "".join(unescape(p["segment"][p["loss_start"] : p["loss_end"]]) for p in found)
                turns = read_turns(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_batches(parts.select("conv_id", slim.alias("parts")), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    path, tokenizer = f"{Scratch(spark, 'chat-files').path}/tree", public_tokenizers.path("byte_bpe_50k.json")
    write_tree(rows.unionByName(probe), path, tokenizer=tokenizer)
    return digests(spark, path, tokenizer)


_SQL_PROBE = PROBE.replace("'", "''")
ORACLE_SQL = {
    "op8_chat_tree": f"""
with r as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, row_number() over () k from conversations
           union all select -7, 0, 'user', '{_SQL_PROBE}', 0 union all select -7, 1, 'assistant', '{_SQL_PROBE}', 0),
     e as (select *, regexp_replace(regexp_replace(text, '\\\\', '\\\\\\\\', 'g'), '<(/?turn)', '\\\\<\\1', 'g') t,
                  regexp_replace(role, '([\\\\<>])', '\\\\\\1', 'g') ro from r)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
       cast(sum(length('<turn ' || ro || '>' || t || '</turn>' || chr(10))) as bigint) formatted_chars
from e group by conv_id, case when conv_id is null then k end
"""
}

QUERIES = {"op8_chat_tree": op8_chat_tree}
