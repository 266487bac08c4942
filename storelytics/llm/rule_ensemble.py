"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees of a random forest give conjunctive rules: each path from a root is a range per statistic. A logistic model with a
lasso penalty weighs the rules and drops most of them. What is left is compiled into one Spark column expression, so scoring needs no model
object. Trees and weights are fitted by Spark's own learners over all labelled rows that are not held out; nothing but
the text enters a score.

Null and empty texts have statistics of zero and a score like any other. Labels that are null or of absent documents count for nothing;
repeated label rows count as often as they come. With no usable label every score is 0.5, and with labels of one class
only it is that class's share after adding one row of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelytics.llm.common import cut, unused

STATS = "_text_stats"
NAMES = [
    "words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "lines", "line_words", "repeated_lines", "repeated_grams",
    "upper", "digits", "marks", "symbols", "other_letters", "bare_words",
]
TREES, DEPTH, PENALTY = 20, 3, 0.002
FIT_PARTS = 32

# Classes of bytes: 1 upper, 2 lower, 3 digit, 4 punctuation, 5 symbols that prose has no use for, 6 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[i for i in range(33, 127) if not _CLASS[i]]] = 4
_CLASS[list(b"#*$%&|<>{}[]^~\\_=+@")] = 5


def statistics(text: str | None) -> list[float]:
    """The numbers of ``NAMES``, most of them shares."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / max(int(lengths.sum()), 1)
    common = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = set(zip(words, words[1:], words[2:]))
    bare = sum(c for w, c in common.items() if not _CLASS[w[0]] in (1, 2, 6))
    return [
        float(n), float(lengths.mean()), float((lengths > 12).mean()), float((lengths < 4).mean()), len(common) / n,
        max(common.values()) / n, float(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines),
        1 - len(grams) / (n - 2) if n > 2 else 0.0, float(kinds[1]), float(kinds[3]), float(kinds[4]), float(kinds[5]), float(kinds[6]), bare / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and an array of the statistics of ``text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [statistics(t.as_py()) for t in batch.column("text")]
            columns = [*batch.columns, pa.array(numbers, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, STATS])

    schema = T.StructType([*docs.drop(STATS).schema.fields, T.StructField(STATS, T.ArrayType(T.DoubleType()))])
    return docs.drop(STATS).mapInArrow(scan, schema)


@dataclass(frozen=True)
class Rule:
    """Ranges ``low < statistic <= high`` that hold together, and the weight of their holding."""

    ranges: tuple[tuple[int, float, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        tests = []
        for i, low, high in self.ranges:
            tests += [F.col(STATS)[i] > F.lit(low)] if low > -np.inf else []
            tests += [F.col(STATS)[i] <= F.lit(high)] if high < np.inf else []
        return F.when(reduce(lambda a, b: a & b, tests), 1.0).otherwise(0.0)

    def __str__(self) -> str:
        return f"{self.weight:+.3f} if " + " and ".join(f"{low:.4g} < {NAMES[i]} <= {high:.4g}" for i, low, high in self.ranges)


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        logit = reduce(lambda a, r: a + r.column() * F.lit(r.weight), self.rules, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _paths(node, ranges: dict[int, tuple[float, float]]) -> Iterator[Rule]:
    """One rule per node below the root of a fitted tree."""
    if ranges:
        yield Rule(tuple((i, *r) for i, r in sorted(ranges.items())))
    if node.subtreeDepth() == 0:
        return
    i, cut_at = node.split().featureIndex(), node.split().threshold()
    low, high = ranges.get(i, (-np.inf, np.inf))
    yield from _paths(node.leftChild(), ranges | {i: (low, min(high, cut_at))})
    yield from _paths(node.rightChild(), ranges | {i: (max(low, cut_at), high)})


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    """Learn from ``labelled`` (the statistics and ``label`` 0 or 1), a table at rest."""
    numbers = dict(labelled.groupBy("label").count().collect())
    if len(numbers) < 2:
        share = (numbers.get(1, 0) + 1) / (sum(numbers.values()) + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    vectors = labelled.select("label", array_to_vector(STATS).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=7, featureSubsetStrategy="onethird").fit(vectors)
    rules = list(dict.fromkeys(r for t in forest.trees for r in _paths(t._java_obj.rootNode(), {})))
    if not rules:
        share = numbers[1] / sum(numbers.values())
        return Ensemble(float(np.log(share / (1 - share))), ())
    held = labelled.select("label", array_to_vector(F.array(*[r.column() for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(held)
    kept = [Rule(r.ranges, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return Ensemble(float(lasso.intercept), tuple(kept))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(numbers: DataFrame, labels: DataFrame, column: str = "quality") -> Ensemble:
    """Fit on the labelled rows of ``numbers`` (doc_id and statistics) that are not held out."""
    marks = labels.filter(F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    rows = numbers.filter(~held_out()).join(marks, "doc_id").select("doc_id", "label", STATS)
    # Samples and bins of the fit go by partition and place: rows are laid out by their values, so any partitioning of the input fits alike.
    order = ["doc_id", "label", STATS]
    return fit(cut(rows.repartition(FIT_PARTS, *order).sortWithinPartitions(*order)).drop("doc_id"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    numbers = cut(with_statistics(docs.select("doc_id", "text")).drop("text"))
    score = learn(numbers, labels).score()
    return numbers.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents predicted good, all columns kept. Rows are told apart by place, so ``docs`` must be a table at rest."""
    row = unused(docs, "_row")
    place = F.monotonically_increasing_id().alias(row)
    numbers = cut(with_statistics(docs.select(place, "doc_id", "text")).drop("text"))
    good = numbers.filter(learn(numbers, labels).score() >= threshold).select(row)
    # What is kept grows with the corpus: the join is a shuffle at every size.
    return docs.select("*", place).join(good.hint("merge"), row, "left_semi").select(*docs.columns)
