"""Quality rules: a decision list learned by sequential covering.

Every text is read once for integer statistics. From the statistics of labelled
documents the learner grows conjunctions of thresholds on half of the rows and
prunes them on the other half, rule by rule, each rule covering rejected
documents that the earlier ones left. The list becomes one ordered
``CASE WHEN`` expression of Spark.

Defined cases: a null text counts as empty (no words, so it fails the base
rules); repeated rows are judged alike; with no labelled rows, or labels of one
class only, the list is empty and the base rules alone decide; an empty table
gives an empty result; other columns, whatever their names, are passed through
by :func:`keep_good` and ignored by :func:`statistics`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.shared import Scratch, in_batches, table
from tributary.llm.shingles import SPACE, draw_keys, pieces, windows, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines")
SAMPLE_ROWS = 20_000  # labelled rows that the learner takes at most, by the smallest hash of their id

_SYMBOL, _UPPER, _MARK, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?,.;:")] = True
_DIGIT[48:58] = True


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated_words(runs: np.ndarray, n: int) -> int:
    """Words of a text of n words that lie in a three-word window found twice or more."""
    if n < 4:
        return 0
    order = np.argsort(runs, kind="stable")
    same = np.diff(runs[order]) == 0
    if not same.any():
        return 0
    found = np.zeros(len(runs), dtype=bool)
    found[1:] |= same
    found[:-1] |= same
    at = order[found]
    covered = np.zeros(n, dtype=bool)
    for j in range(3):
        covered[at + j] = True
    return int(covered.sum())


def _duplicate_lines(raw: bytes) -> tuple[int, int]:
    lines = raw.split(b"\n")
    if len(lines) == 1:
        return 0, 1
    worded = [x for x in lines if x.strip(b" \t\n\v\f\r")]
    return len(worded) - len(set(worded)), len(lines)


def text_counts(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    hashes, _, _, first = words(data, offsets, keys, fold=False)
    runs = windows(hashes, 3, keys)
    spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    lines = [_duplicate_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return {
        "n_words": np.diff(first),
        "word_chars": _count(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _count(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([x for x, _ in lines], dtype=np.int64),
        "n_repeat_words": np.array([_repeated_words(runs[a : max(a, b - 2)], b - a) for a, b in spans], dtype=np.int64),
        "n_upper": _count(_UPPER[data], offsets),
        "n_marks": _count(_MARK[data], offsets),
        "n_digits": _count(_DIGIT[data], offsets),
        "n_lines": np.array([x for _, x in lines], dtype=np.int64),
    }


def with_counts(docs: DataFrame, keep: list[str], text: str = "text", into: str = "counts") -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct of text statistics named ``into``."""
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    kinds = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(into, kinds)])
    keys = draw_keys()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text):
            counts = text_counts(data, offsets, keys)
            struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], struct], [*keep, into])

    return in_batches(source, counted, schema)


def features(counts: str = "counts") -> dict[str, Column]:
    """What rules test: whole numbers, mostly parts per thousand."""
    part = lambda a, b: F.floor(F.col(f"{counts}.{a}") * 1000 / F.greatest(F.col(f"{counts}.{b}"), F.lit(1)))
    return {
        "words": F.col(f"{counts}.n_words"),
        "symbols_per_1000_chars": part("n_symbols", "word_chars"),
        "upper_per_1000_chars": part("n_upper", "word_chars"),
        "marks_per_1000_chars": part("n_marks", "word_chars"),
        "digits_per_1000_chars": part("n_digits", "word_chars"),
        "repeats_per_1000_words": part("n_repeat_words", "n_words"),
        "repeats_per_1000_lines": part("n_dup_lines", "n_lines"),
        "chars_per_1000_words": part("word_chars", "n_words"),
    }


def base_failed(counts: str = "counts") -> Column:
    n = F.col(f"{counts}.n_words")
    return (n < 50) | (100 * F.col(f"{counts}.n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Threshold:
    feature: str
    at_least: bool
    value: int

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        x = rows[self.feature].to_numpy()
        return x >= self.value if self.at_least else x <= self.value

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.value if self.at_least else of[self.feature] <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document that the first matching rule rejects goes, one that none matches stays."""

    rules: tuple[tuple[Threshold, ...], ...] = ()

    def keeps(self, counts: str = "counts") -> Column:
        of = features(counts)
        matched = [reduce(lambda a, b: a & b, (t.column(of) for t in rule)) for rule in self.rules]
        if not matched:
            return F.lit(True)
        first, *rest = matched
        return reduce(lambda case, rule: case.when(rule, F.lit(False)), rest, F.when(first, F.lit(False))).otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([f"reject if {' and '.join(map(str, r))}" for r in self.rules] + ["else keep"])


def _covers(rule: tuple[Threshold, ...], rows: pd.DataFrame) -> np.ndarray:
    return reduce(lambda a, b: a & b, (t.holds(rows) for t in rule), np.ones(len(rows), dtype=bool))


def _grow(rows: pd.DataFrame, bad: np.ndarray, names: list[str], most: int, cuts: int) -> tuple[Threshold, ...]:
    """Add the threshold of most information gain until only rejected rows are covered."""
    rule: tuple[Threshold, ...] = ()
    inside = np.ones(len(rows), dtype=bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p:
            break
        best, gain, covered = None, 1e-9, inside
        for name in names:
            x = rows[name].to_numpy()
            for value in np.unique(np.quantile(x[inside], np.linspace(0, 1, cuts), method="nearest")):
                for at_least in (True, False):
                    t = Threshold(name, at_least, int(value))
                    now = inside & (x >= value if at_least else x <= value)
                    p1, n1 = (now & bad).sum(), (now & ~bad).sum()
                    if p1 and (g := p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))) > gain:
                        best, gain, covered = t, g, now
        if best is None:
            break
        rule, inside = (*rule, best), covered
    return rule


def _worth(rule: tuple[Threshold, ...], rows: pd.DataFrame, bad: np.ndarray) -> float:
    covered = _covers(rule, rows)
    p, n = (covered & bad).sum(), (covered & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: pd.DataFrame, target: str = "quality", precision: float = 0.97, most_rules: int = 12, most_conditions: int = 3, cuts: int = 48) -> DecisionList:
    """Sequential covering over labelled statistics (target 0: reject, 1: keep).

    A rule stays if at least ``precision`` of the held-back rows it covers are
    rejected ones; the first that isn't ends the list.
    """
    rows = rows.dropna().reset_index(drop=True)
    names = [c for c in rows.columns if c != target]
    rules: list[tuple[Threshold, ...]] = []
    while len(rules) < most_rules and (rows[target] == 0).any() and (rows[target] != 0).any():
        grow, prune = rows.iloc[::2], rows.iloc[1::2]
        bad, held = (grow[target] == 0).to_numpy(), (prune[target] == 0).to_numpy()
        rule = _grow(grow, bad, names, most_conditions, cuts)
        while len(rule) > 1 and _worth(rule[:-1], prune, held) >= _worth(rule, prune, held):
            rule = rule[:-1]
        covered = _covers(rule, prune)
        if not rule or not covered.any() or held[covered].mean() < precision:
            break
        rules.append(rule)
        rows = rows[~_covers(rule, rows)].reset_index(drop=True)
    return DecisionList(tuple(rules))


def fit(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id", counts: str = "counts", sample: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from the labelled documents, of which at most ``sample`` go to the driver."""
    of = features(counts)
    known = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min("quality").alias("_quality"))
    rows = (
        counted.where(~base_failed(counts))
        .join(known, F.col(doc_id) == F.col("_id"))
        .orderBy(F.xxhash64("_id"), *[F.col(f"{counts}.{c}") for c in COUNTS])
        .limit(sample)
        .select(*[c.alias(name) for name, c in of.items()], F.col("_quality").alias("quality"))
    )
    return learn(rows.toPandas())


def _fresh(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """doc_id, the counts and the verdict of each document; and the list that judged."""
    counted = Scratch(spark, "quality").save(with_counts(docs, ["doc_id"]), "counts")
    rules = fit(counted, labels)
    failed = base_failed()
    return counted.select("doc_id", "counts", failed.alias("base_failed"), (~failed & rules.keeps()).alias("kept")), rules


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, in all their columns, that neither the base rules nor the learned list reject. Each text is read and counted once."""
    into = _fresh(docs, "counts")
    counted = Scratch(spark, "quality").save(with_counts(docs, docs.columns, into=into), "counted")
    rules = fit(counted, labels, counts=into)
    return counted.where(~base_failed(into) & rules.keeps(into)).drop(into)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in COUNTS[:5]], "base_failed", "kept")


QUERIES = {"op7_quality_rules": op7_quality_rules}
