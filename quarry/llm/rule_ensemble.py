r"""Quality classifier: a sparse ensemble of rules over statistics of the text.

`statistics` reads every whole text once and gives figures of its letters, words and lines (FIGURES);
no labels, languages, sources or ids are among them. `fit` grows shallow random trees on labelled
rows; every path from a root to a node is a rule, a conjunction of bounds on figures. Rules
that hold for nearly all or nearly no rows and repeated ones go; lasso logistic regression weighs
the rest, and most weights become zero. `RuleEnsemble.score` compiles the remaining rules
into one Spark column expression, so that scoring is a projection without Python.

The model is fitted on at most `sample` labelled rows, those least by a hash of their id (every labelled row
where there are fewer); statistics, rules and scores cover all rows. Rows whose crc32 of the id, as text,
leaves 0 modulo HOLD_OUT are held out: no label of theirs is used.

A null or empty text has figures 0 and is scored like any other. A null id is read as ''. Labels that are null or name no
document are left out; of several labels of one id each counts, as does each of repeated rows. Without labelled rows,
or with one class only, there are no rules and every score is (positives + 1) / (rows + 2). An empty
table gives no rows. Other columns of both tables do not matter.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import keyed_text, python_ready, stored
from quarry.llm.words import WHITE_SPACE, find_words, hash_words, slices, text_buffer

HOLD_OUT = 5
SAMPLE = 20_000
TREES, DEPTH = 24, 4
LASSO = 0.0003
RARE = 0.002               # share of rows that a rule must hold and fail for
THRESHOLD = 0.3
SEED = 12

#: statistics of a text; shares are of its letters, characters, words or lines
FIGURES = ["log_chars", "log_words", "word_chars", "capitals", "marks", "ends", "symbols", "digits", "others", "loud", "bars",
           "line_words", "repeats", "distinct", "common", "line_repeats", "longest_word"]

_KINDS = {"Lu": 1, "Lt": 1, "Ll": 2, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3}
# characters that stand in running text for punctuation, that end sentences, and symbols
_ENDS, _SYMBOLS = ".!?…。！？।؟۔", "#*$%&<>@^~=+\\_{}[]"


@cache
def kinds() -> np.ndarray:
    """Kind of each character of the first plane: 0 other, 1 capital, 2 letter, 3 digit, 4 mark, 5 end of sentence,
    6 symbol, 7 bar, 8 white space, 9 line feed, 10 exclamation mark."""
    def kind(c: str) -> int:
        if c == "\n":
            return 9
        if c in " \t\x0b\x0c\r" or c.isspace():
            return 8
        if c == "!":
            return 10
        if c == "|":
            return 7
        if c in _ENDS:
            return 5
        if c in _SYMBOLS:
            return 6
        category = unicodedata.category(c)
        return _KINDS.get(category, 4 if category[0] == "P" else 6 if category[0] == "S" else 0)
    return np.array([kind(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(1 << 16)], np.uint8)


def _runs(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of `values` over the stretches between offsets (0 for empty ones)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def figures(col: pa.Array) -> np.ndarray:
    """The statistics (rows by FIGURES) of a string column."""
    texts = [t or "" for t in col.to_pylist()]
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds()[np.minimum(points, 0xFFFF)]
    row = np.repeat(np.arange(n), lengths)
    k = np.bincount(row * 11 + kind, minlength=n * 11).reshape(n, 11).astype(float)
    line = kind == 9
    buf, at = text_buffer(col)
    starts, ends, words = find_words(buf, at, WHITE_SPACE)
    n_words = np.diff(words)
    hashes = hash_words(buf, starts, ends)
    of = np.repeat(np.arange(n), n_words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.empty(0, np.int64)
    distinct = np.bincount(o[first], minlength=n) if len(h) else np.zeros(n)
    common = np.zeros(n)
    if len(h):
        np.maximum.at(common, o[first], np.diff(np.append(first, len(h))))
    longest = np.zeros(n)
    np.maximum.at(longest, of, ends - starts)
    same = np.array([len(x) - len(set(x)) for x in ([y for y in t.split("\n") if y.strip()] for t in texts)])
    letters, lines, chars, w = k[:, 1] + k[:, 2], _runs(line, off) + 1, np.maximum(lengths, 1), np.maximum(n_words, 1)
    return np.column_stack([
        np.log1p(lengths), np.log1p(n_words), (lengths - k[:, 8] - k[:, 9]) / w, k[:, 1] / np.maximum(letters, 1), (k[:, 4] + k[:, 5] + k[:, 10]) / w,
        k[:, 5] / w, k[:, 6] / w, k[:, 3] / chars, k[:, 0] / chars, k[:, 10] / w, k[:, 7] / w, n_words / lines,
        _runs(again, words) / w, distinct / w, common / w, same / lines, np.log1p(longest)])


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, *FIGURES) of every row."""
    python_ready(docs.sparkSession)
    rows = keyed_text(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = figures(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, np.ascontiguousarray(x.T))], ["doc_id", *FIGURES])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} double" for f in FIGURES)]))


def remainder(key: Column) -> Column:
    """crc32 of the id as text, modulo HOLD_OUT."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(HOLD_OUT))


@dataclass(frozen=True)
class Rule:
    """All of (figure, above, bound): figure > bound or figure <= bound."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > b if above else F.col(f) <= b for f, above, b in self.parts])

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {b:g}" for f, above, b in self.parts)


@dataclass
class RuleEnsemble:
    base: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Probability of label 1 as an expression over FIGURES."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights.items()], F.lit(self.base))
        return 1 / (1 + F.exp(-total))


def tree_rules(tree) -> set[Rule]:
    """The paths from a tree's root to each of its other nodes, bounds on one figure joined."""
    out: set[Rule] = set()

    def walk(node, bounds: dict[tuple[str, bool], float]) -> None:
        if bounds:
            out.add(Rule(tuple(sorted((f, above, b) for (f, above), b in bounds.items()))))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, bound = FIGURES[split.featureIndex()], split.threshold()
        low, high = (name, False), (name, True)
        walk(node.leftChild(), {**bounds, low: min(bound, bounds.get(low, math.inf))})
        walk(node.rightChild(), {**bounds, high: max(bound, bounds.get(high, -math.inf))})
    walk(tree._call_java("rootNode"), {})
    return out


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Rules and weights from the labelled rows that are not held out."""
    given = labels.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label")).filter("label IS NOT NULL")
    rows = stats.join(given, "doc_id").filter(remainder(F.col("doc_id")) != 0)
    rows = stored(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", *FIGURES).limit(sample).select("label", *FIGURES), "sample")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (positive + 1) / (n + 2)
    plain = RuleEnsemble(math.log(share / (1 - share)))
    if not 0 < positive < n:
        return plain
    grown = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInfoGain=1e-4, seed=SEED, featureSubsetStrategy="onethird",
                                   subsamplingRate=0.7, cacheNodeIds=False).fit(VectorAssembler(inputCols=FIGURES, outputCol="x").transform(rows).select("x", "label"))
    rules = sorted(set().union(*map(tree_rules, grown.trees)), key=str)
    if not rules:
        return plain
    held = rows.agg(*[F.count_if(r.column()).alias(f"r{i}") for i, r in enumerate(rules)]).first()
    rules = [r for r, m in zip(rules, held) if RARE * n <= m <= (1 - RARE) * n]
    if not rules:
        return plain
    names = [f"r{i}" for i in range(len(rules))]
    table = rows.select("label", *[r.column().cast("double").alias(c) for r, c in zip(rules, names)])
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100)
    model = lasso.fit(VectorAssembler(inputCols=names, outputCol="x").transform(table).select("x", "label"))
    return RuleEnsemble(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6})


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stats = stored(statistics(docs), "statistics")
    score = fit(stats, labels, sample=sample).score().alias("score")
    scored = stats.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), score)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
