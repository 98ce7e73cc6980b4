"""Self-join of documents by Jaccard similarity of their word shingles, exact.

Signatures. All documents order their shingles alike: rare ones first, in hash
order, then those that were seen often. A set of n shingles links only with sets
that miss at most ``n - ceil(0.75 n)`` of its shingles. Often seen shingles form
classes: class 1 is indexed by single shingles, class k by combinations of k. With
c_k shingles of class k in a prefix, two linked sets share k shingles of some class
k as soon as the sum over k of max(0, c_k - k + 1) exceeds the number that may be
missed; a prefix is extended until it does. All combinations of a class in a
prefix are indexed, so no link is lost, and a shingle that many texts share never
has a list of all of them. The table of often seen shingles only orders: any
content gives the same links. It is counted over all texts, and the
``frequent_entries`` most counted entries are kept, which bounds it.

Links. Equal sets are one node. In some rounds the members of each signature's list
are compared with one of them only, which is linear, and components of the links
found so far follow. Lists in one component are done. The members of the others
are compared across components at last, which a group of many near copies
mostly doesn't reach. Each member of a list says the largest set it can link with,
were the signature the first they share (its reach); the first one that linked sets
share passes that on both sides. Members that the list's smallest size or largest
reach rule out leave it before anything is compared, and what is left is compared
by classes of equal size and reach, so pages that share a template but not three
quarters of their shingles cost no comparisons. Pairs are verified on the texts.

Hashes of shingles have random keys for each run and nodes are 128 bits of a digest
of the set: their first half, or their second where two sets share the first half, so
two different sets are never one node but by a collision of all 128 bits.

Defined cases: null and empty texts have the empty set and link with nothing; a
text of fewer than five words is one shingle; equal texts are linked whatever
their ids; rows with a null id link as others do, and are returned with the smallest
id of their component, null if it has none; repeated rows are returned each; rows
of one id with different texts are documents of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.graph import components
from tributary.llm.shared import Scratch, in_batches, release, table
from tributary.llm.shingles import U64, combined, document_sets, draw_keys, mix, one_text, pieces, set_hash

PERCENT = 75
CLASS_FLOORS = (64, 100_000)  # texts from which a shingle is of class 2, of class 3
ORDER_FLOOR = 3  # texts from which a shingle's count takes part in the order
FREQUENT_ENTRIES = 1 << 20
HEAVY = 64  # sets of one task's batch from which a signature's rows are kept apart
FLUSH = 1 << 20  # postings that a task holds
_FILTER_BITS = 22
_SMALL = U64(0xA0761D6478BD642F)
STAR_ROUNDS = 2


def repeated(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur twice or more, and how often; sorts ``shingles`` in place and copies only those."""
    shingles.sort()
    same = np.zeros(len(shingles) + 1, dtype=bool)  # whether a value equals the one before
    same[1:-1] = shingles[1:] == shingles[:-1]
    first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    return shingles[first], last - first + 1


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text; null reads as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def node_of(shingles: np.ndarray, clashes: frozenset[int] = frozenset()) -> tuple[int, int]:
    """A set's node, 0 for the empty set, and the other half of its digest."""
    node, other = set_hash(shingles)
    return (other, node) if node in clashes else (node, other)


def set_rows(docs: DataFrame, keys: np.ndarray, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Rows of documents (doc_id, text_key, node, other, n) and of shingles seen repeatedly in a task (node: the shingle, n: its texts; doc marks the kind)."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc", "doc_id", "text_key", "node", "other", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, nodes_seen, ids = [], set(), None
        for rows, data, offsets in pieces(batches, "text"):
            nodes, others, sizes, ids = [], [], [], rows.column("doc_id").type
            for s in document_sets(data, offsets, keys):
                node, other = node_of(s, clashes)
                nodes.append(node)
                others.append(other)
                sizes.append(len(s))
                if node not in nodes_seen:
                    nodes_seen.add(node)
                    seen.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(nodes), pa.bool_()), rows.column("doc_id"), rows.column("text_key"), *(pa.array(x, pa.int64()) for x in (nodes, others, sizes))], names)
            if sum(map(len, seen)) > 4_000_000:
                yield counted(seen, ids)
                seen = []
        if seen:
            yield counted(seen, ids)

    def counted(seen: list[np.ndarray], ids: pa.DataType) -> pa.RecordBatch:
        found, times = repeated(np.concatenate(seen))
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([False] * n, pa.bool_()), pa.nulls(n, ids), pa.nulls(n, pa.binary()), pa.array(found.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))], names)

    schema = T.StructType([T.StructField("doc", T.BooleanType()), T.StructField("doc_id", kind), T.StructField("text_key", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in names[3:])])
    return in_batches(docs.select("doc_id", "text", text_key().alias("text_key")), run, schema)


class Frequent:
    """Classes of shingles: 1, or more for those seen in many texts."""

    def __init__(self, shingles: np.ndarray, texts: np.ndarray, floors: tuple[int, ...] = CLASS_FLOORS):
        order = np.argsort(shingles)
        self.keys = shingles[order]
        self.classes = (1 + np.searchsorted(np.array(floors), texts[order], side="right")).astype(np.int8)
        self.texts = texts[order]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.keys >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class and the texts counted of each shingle."""
        classes, texts = np.ones(len(shingles), dtype=np.int8), np.zeros(len(shingles), dtype=np.int64)
        at = np.flatnonzero(self.filter[(shingles >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(at) and len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, shingles[at]), len(self.keys) - 1)
            hit = self.keys[slot] == shingles[at]
            classes[at[hit]], texts[at[hit]] = self.classes[slot[hit]], self.texts[slot[hit]]
        return classes, texts


def needed(n: int, percent: int) -> int:
    """One more than the shingles that a set of n may miss in a set it links with."""
    return n - (percent * n + 99) // 100 + 1


def _combined(shingles: np.ndarray, classes: np.ndarray, need: int, bucket: int, percent: int, keys: np.ndarray) -> list[np.ndarray]:
    """Signatures under a size bucket's split of the classes; classes are in prefix order.

    Class k is split by hash into parts, which count as classes of their own, so that
    a prefix full of frequent shingles has few in each part and few combinations.
    """
    smallest = math.ceil((100 / percent) ** bucket)
    parts = {k: max(1, needed(smallest, percent) // k) for k in range(2, len(CLASS_FLOORS) + 2)}
    counts: dict[tuple[int, int], list[int]] = defaultdict(list)
    kinds = classes.tolist()
    rare = int(np.argmax(classes > 1)) if (classes > 1).any() else len(kinds)
    gained = size = min(rare, need)
    before = list(range(size))
    while gained < need:
        if size == len(kinds):
            raise AssertionError("a set above the small sizes always has enough shingles")
        before.append(gained)
        k = kinds[size]
        part = counts[k, int(shingles[size] % U64(parts[k]))]
        part.append(size)
        gained += len(part) >= k
        size += 1
    spots = np.array(before, dtype=np.int64)
    single = min(rare, size)
    found = [(shingles[:single], spots[:single])]
    for (k, part), own in counts.items():
        if len(own) >= k:
            picks = np.array(list(itertools.combinations(own, k)))
            tag = mix(np.array([(bucket << 40) + (part << 8) + k], dtype=U64))
            found.append((mix(combined(shingles[picks], keys) ^ tag), spots[picks[:, -1]]))
    return found


def signatures(shingles: np.ndarray, frequent: Frequent, keys: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the indexed combinations of a set, of which two linked sets share one at least, and their spots.

    A combination's spot is the number of the set's shingles that another set lacks
    at least if this is the first combination, in the common order, that they share.

    Sets link within a ratio of sizes, so with sets of their own size bucket or of
    the next: each set is indexed under its bucket and the one above. Sets so small
    that combinations may be lacking are indexed by the single shingles of their
    prefix, apart from the others, and so are those they can link with.
    """
    n = len(shingles)
    if not n:
        return shingles, np.empty(0, dtype=np.int64)
    lacking = sum(range(1, len(CLASS_FLOORS) + 1)) * 100 // percent
    need = needed(n, percent)
    classes, texts = frequent.of(shingles)
    order = np.lexsort((mix(shingles), texts))
    ordered, classes = shingles[order], classes[order]
    found = []
    if n <= lacking * 100 // percent:
        found.append((mix(ordered[:need] ^ _SMALL), np.arange(need)))
    if n > lacking:
        bucket = int(math.log(n) / math.log(100 / percent) + 1e-9)
        for b in (bucket, bucket + 1):
            found += _combined(ordered, classes, need, b, percent, keys)
            if not (classes[:need] > 1).any():
                break
    sigs, spots = (np.concatenate(x) for x in zip(*found, strict=True))
    sigs, at = np.unique(sigs, return_index=True)
    return sigs, spots[at]


def reach(n: np.ndarray, spots: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that one of n shingles can link with if a signature at these spots is the first they share.

    Links of n and m need an overlap of percent / (100 + percent) of n + m, and n - spot are left for it.
    """
    return (100 + percent) * (n - spots) // percent - n


def postings(docs: DataFrame, frequent, keys: np.ndarray, percent: int = PERCENT, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """sig, node, n, reach, heavy: the signatures of each distinct set (sets met again in a task are skipped).

    heavy: at least HEAVY sets of this task's batch have the signature.
    """
    names = ["sig", "node", "n", "reach", "heavy"]

    def flushed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        sigs, nodes, sizes, reaches = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(sigs)
        same = sigs[order]
        starts = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        times = np.diff(np.append(starts, len(same)))
        heavy = np.empty(len(sigs), dtype=bool)
        heavy[order] = np.repeat(times >= HEAVY, times)
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(nodes), pa.array(sizes), pa.array(reaches), pa.array(heavy)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = set(), [], 0
        for _, data, offsets in pieces(batches, "text"):
            for s in document_sets(data, offsets, keys):
                node, _ = node_of(s, clashes)
                if node and node not in seen:
                    seen.add(node)
                    own, spots = signatures(s, frequent.value, keys, percent)
                    held.append([own, np.full(len(own), node, dtype=np.int64), np.full(len(own), len(s), dtype=np.int64), reach(np.int64(len(s)), spots, percent)])
                    n += len(own)
                    if n > FLUSH:
                        yield flushed(held)
                        held, n = [], 0
        if held:
            yield flushed(held)

    return in_batches(docs.select("text"), run, "sig long, node long, n long, reach long, heavy boolean")


def _lists(docs: DataFrame, frequent, keys: np.ndarray, percent: int, clashes: frozenset[int], scratch: Scratch) -> DataFrame:
    """The signatures that several sets have: sig, node, n, reach.

    Rows of a signature that is heavy in some task's batch are kept without a look at
    the others. The window over the rest then has less than HEAVY rows of a signature
    from each batch, so no list of very many sets comes together in a task.
    """
    posts = scratch.save(postings(docs, frequent, keys, percent, clashes), "posts", partition_by=["heavy"])
    heavy = posts.where("heavy").select("sig", "node", "n", "reach")
    known = scratch.save(heavy.select("sig").distinct(), "heavy-sigs")
    over = Window.partitionBy("sig")
    ranked = posts.where("not heavy").select("sig", "node", "n", "reach", F.min("node").over(over).alias("low"), F.max("node").over(over).alias("high"))
    marked = ranked.join(known.withColumn("known", F.lit(True)), "sig", "left")
    several = marked.where("low <> high or known").select("sig", "node", "n", "reach")
    lists = scratch.save(several.unionByName(heavy).distinct(), "lists")
    scratch.drop("posts")
    release(docs.sparkSession)
    return lists


def _open(lists: DataFrame, labels: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The members, with their labels, of lists with several labels, that some size and reach in their list allow to link.

    Written tables meet, not aggregates: so Spark splits the join where a list is hot.
    """
    own = F.col("node").alias("label") if labels is None else F.coalesce("component", "node").alias("label")
    labelled = (lists if labels is None else lists.join(labels, "node", "left")).select("sig", "node", "n", "reach", own)
    if labels is not None:
        labelled = scratch.save(labelled, f"labelled-{name}")
    stats = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("reach").alias("far"))
    stats = scratch.save(stats.where("low <> high and least <= far"), f"stats-{name}")
    members = labelled.join(stats, "sig").where("reach >= least and n <= far").select("sig", "node", "n", "reach", "label")
    return scratch.save(members, f"open-{name}")


def _with_first(members: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of each member with one of its list: one that lacks few of the list's common shingles, another each round."""
    spot = F.expr(f"n - ({percent} * (n + reach)) div {100 + percent}")
    rank = F.struct((spot + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 + 4 * k))).alias("rank"), "node", "n", "reach", "label")
    hubs = scratch.save(members.groupBy("sig").agg(F.min(rank).alias("hub")).select("sig", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "reach", "label")]), f"hubs-{k}")
    near = members.join(hubs, "sig").where("label <> hub_label and n <= hub_reach and hub_n <= reach")
    return near.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b"))


def _across(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members of different labels whose sizes and reaches allow a link, found by way of the classes of equal size and reach."""
    classes = scratch.save(members.groupBy("sig", "n", "reach").agg(F.min("label").alias("low"), F.max("label").alias("high")), "classes")
    side = lambda c, *names: [F.col(x).alias(f"{x}_{c}") for x in names]
    of = ("n", "reach")
    left, right = (classes.select("sig", *side(c, *of, "low", "high")) for c in "ab")
    met = left.join(right, "sig").where("n_a <= reach_b and n_b <= reach_a and (n_a < n_b or (n_a = n_b and reach_a <= reach_b)) and not (low_a = high_b and high_a = low_b)")
    met = scratch.save(met.select("sig", *[f"{x}_{c}" for c in "ab" for x in of]), "class-pairs")
    labels = scratch.save(members.select("sig", *of, "label").distinct(), "class-labels")
    for c in "ab":
        met = met.join(labels.select("sig", *side(c, *of, "label")), ["sig", *[f"{x}_{c}" for x in of]])
    met = scratch.save(met.where("label_a <> label_b"), "label-pairs")
    for c in "ab":
        met = met.join(members.select("sig", *side(c, *of, "label", "node")), ["sig", *[f"{x}_{c}" for x in (*of, "label")]])
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, keys: np.ndarray, percent: int = PERCENT, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have the similarity."""
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for rows, _, _ in pieces(batches, "text_b"):
            linked = []
            columns = [rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("text_a"), rows.column("text_b")]
            for i, (a, b) in enumerate(zip(columns[0], columns[1], strict=True)):
                sets = []
                for node, column in ((a, columns[2]), (b, columns[3])):
                    s = held.get(node)
                    if s is None:
                        if sum(map(len, held.values())) > 1_000_000:
                            held.clear()
                        s = held[node] = next(document_sets(*one_text(column[i].as_py()), keys))
                        if node_of(s, clashes)[0] != node:
                            raise ValueError(f"the text kept for the set {node} has another set")
                    sets.append(s)
                x, y = sets
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    linked.append((a, b))
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*linked, strict=True)], ["a", "b"])

    return in_batches(both, run, "a long, b long")


def frequent_shingles(rows: DataFrame, entries: int = FREQUENT_ENTRIES) -> Frequent:
    """The most often seen shingles, at most ``entries``; they only order the others' index."""
    seen = rows.where(~F.col("doc")).groupBy("node").agg(F.sum("n").alias("texts")).where(F.col("texts") >= ORDER_FLOOR)
    top = seen.orderBy(F.desc("texts"), "node").limit(entries).toPandas()
    return Frequent(top["node"].to_numpy(np.int64).view(U64), top["texts"].to_numpy(np.int64))


def _nodes(docs: DataFrame, keys: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """The written set rows, the nodes with the key of a text of each, and the halves of digests that several sets share (none is expected)."""
    clashes: frozenset[int] = frozenset()
    while True:
        name = f"-{len(clashes)}"
        rows = scratch.save(set_rows(docs, keys, clashes), f"sets{name}", partition_by=["doc"])
        nodes = rows.where("doc and node <> 0").groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high"), F.min("text_key").alias("text_key"))
        nodes = scratch.save(nodes, f"nodes{name}")
        more = {r.node for r in nodes.where("low <> high").select("node").collect()}
        if not more:
            return rows, nodes.select("node", "text_key"), clashes
        if more <= clashes:
            raise ValueError("different sets have equal digests")
        clashes |= more


def grouped(docs: DataFrame, percent: int = PERCENT, keep: bool = False) -> tuple[DataFrame, Scratch]:
    """doc_id, text_key, n, component (null for the empty set), n_links for each document; and the folder of the tables behind it."""
    if percent < 70:
        raise ValueError("the split of frequent classes needs a similarity of 0.7 or more")
    spark, keys = docs.sparkSession, draw_keys()
    scratch = Scratch(spark, "ngram-join")
    rows, nodes, clashes = _nodes(docs, keys, scratch)
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows))
    lists = _lists(docs, frequent, keys, percent, clashes, scratch)
    tried = links = labels = texts = None
    for k in range(STAR_ROUNDS + 1):
        members = _open(lists, labels, scratch, str(k))
        if texts is None:  # those of sets in open lists, once each
            wanted = scratch.save(members.select("node").distinct().join(nodes, "node"), "wanted")
            found = docs.select(text_key().alias("text_key"), "text").join(wanted, "text_key").select("node", F.coalesce("text", F.lit("")).alias("text"))
            texts = scratch.save(found.dropDuplicates(["node"]), "texts")
        pairs = (_across(members, scratch) if k == STAR_ROUNDS else _with_first(members, k, percent, scratch)).distinct()
        pairs = scratch.save(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, f"pairs-{k}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = scratch.save(verified(pairs, texts, keys, percent, clashes), f"links-{k}")
        links = fresh if links is None else links.unionByName(fresh)
        if labels is None or not fresh.isEmpty():
            labels = components(links, scratch, f"labels-{k}")
        scratch.drop("lists" if k == 0 else f"open-{k - 1}", f"labelled-{k}", f"stats-{k}", f"hubs-{k}")
        release(spark)
        lists = members.drop("label")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    # written, so that Spark splits the join of copies with their node
    reps = nodes.select("node").join(labels, "node", "left").join(degree, "node", "left")
    reps = scratch.save(reps.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "components")
    known = rows.where("doc").select("doc_id", "text_key", "node", "n")
    done = known.join(reps, "node", "left").select("doc_id", "text_key", "n", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    done = scratch.save(done, "grouped")
    scratch.drop("texts", "components", *(f"sets-{len(clashes)}", f"nodes-{len(clashes)}"), f"open-{STAR_ROUNDS}", "classes", "class-pairs", "class-labels", "label-pairs")
    release(spark)
    return done, scratch


def join_similar(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to), n_links for each document.

    n_links counts the verified links of the document's set with other sets; links
    that the components made needless are not sought.
    """
    done, scratch = grouped(docs, percent)
    smallest = scratch.save(done.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    return done.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "n_links"
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, in all its columns: the one with the smallest id, and of that id's the smallest text key.

    Rows without words are groups of their own. Of rows that have both id and text in common one
    stays, but rows without id and words stay each.
    """
    done, scratch = grouped(docs, percent)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = done.where("component is not null").groupBy("component").agg(F.min(first).alias("first")).select("first.doc_id", "first.text_key")
    chosen = chosen.unionByName(done.where("component is null and doc_id is not null").select("doc_id", "text_key").distinct())
    chosen = scratch.save(chosen.toDF("_kept_id", "_kept_key"), "chosen")
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    key = "_text_key"
    while key in docs.columns:
        key = f"_{key}"
    keyed = docs.where(~bare).withColumn(key, text_key())
    kept = keyed.join(chosen, (F.col(key) == F.col("_kept_key")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi").dropDuplicates(["doc_id", key])
    return kept.drop(key).unionByName(docs.where(bare))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = {
    "op6_ngram_join": """
with recursive
w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        when len(w) > 0 then ['<' || array_to_string(w, ' ')] else [] end) s from w),
g as (select doc_id, len(s) n, unnest(s) g from s),
shared as (select a.doc_id a, b.doc_id b, any_value(a.n) n, any_value(b.n) m, count(*) c from g a join g b using (g) where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared where 100 * c >= 75 * (n + m - c)),
reach as (select doc_id a, doc_id b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, cast(len(s) as bigint) n_shingles, low component_id
from s join (select a, min(b) low from reach group by a) on a = doc_id
"""
}

QUERIES = {"op6_ngram_join": op6_ngram_join}
