"""Text quality by a sparse rule ensemble (conjunctive rules from trees, lasso logistic weights).

1. ``statistics``: character-class shares, word shape and repetition of the whole text, as Spark columns.
2. A small random forest is fitted on a sample of labelled rows; every path from a root to a node below it
   is one conjunctive rule over the statistics.
3. A logistic regression with an L1 penalty weighs the rules; most weights become zero.
4. The rules left are compiled into one Spark column expression, so scoring is a projection.

Training reads at most ``SAMPLE_ROWS`` labelled rows, those of least crc32 of the salted id, which is a
parameter; statistics and scores cover every row. Only ``text`` enters a score: labels, lang, source and
ids never do. Rows whose crc32(doc_id as text) mod 3 is 1 are held out of training.

Edge cases: null and empty texts have statistics of 0 and get a score like any other; a null doc_id is
never trained on and not held out; a doc_id labelled more than once counts by the mean of its labels, and null labels do
not count; without rows of both labels the score is the share of label 1 among the training rows, 0.5
without any; repeated rows get equal scores; input columns named like an added one are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import column, fresh, stored, without

SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 20, 3, 0.002, 7

_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "symbol": "#$%&*!|<>{}[]=+~^_@\\/",
    "stop": ".,;:?",
    "blank": " \t\n\r",
    "line": "\n",
}
STATISTICS = ("s_length", *(f"s_{k}" for k in _CLASSES), "s_word", "s_distinct", "s_repeat")


def statistics(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the columns of STATISTICS, or the names given for them."""
    of = names or {name: name for name in STATISTICS}
    out = without(docs, of.values())
    own = fresh(out, "text", "words")
    value, words = F.col(own["text"]), F.col(own["words"])
    size, count = F.length(value), F.size(words)
    share = {f"s_{k}": (size - F.length(F.translate(value, chars, ""))) / F.greatest(size, F.lit(1)) for k, chars in _CLASSES.items()}
    shorter = F.greatest(count - 1, F.lit(0))
    again = F.size(F.filter(F.zip_with(F.slice(words, 1, shorter), F.slice(words, 2, shorter), lambda a, b: a == b), lambda same: same))
    out = out.withColumn(own["text"], F.coalesce(column(text).cast("string"), F.lit("")))
    out = out.withColumn(own["words"], F.split(F.lower(value), " "))
    measured = {
        "s_length": F.log1p(size.cast("double")),
        **share,
        "s_word": size / count,
        "s_distinct": F.size(F.array_distinct(words)) / count,
        "s_repeat": again / count,
    }
    return out.withColumns({of[k]: v for k, v in measured.items()}).drop(own["text"], own["words"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, "<=" or ">", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, names: dict[str, str] | None = None) -> Column:
        of = lambda s: F.col(names[s] if names else s)
        tests = [of(s) <= t if sign == "<=" else of(s) > t for s, sign, t in self.conditions]
        return reduce(Column.__and__, tests).cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, names: dict[str, str] | None = None) -> Column:
        """The probability of label 1 as a column over STATISTICS, or the names given for them."""
        margin = reduce(Column.__add__, [F.lit(w) * rule.column(names) for rule, w in self.weighted], F.lit(self.bias))
        return 1 / (1 + F.exp(-margin))


_LINE = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)")


def tree_rules(description: str, names: tuple[str, ...]) -> list[Rule]:
    """The distinct rules of a forest's description: one for every path from a root."""
    path: list[tuple[int, tuple[str, str, float]]] = []
    rules: dict[Rule, None] = {}
    for line in description.splitlines():
        if line.lstrip().startswith("Tree"):
            path = []
        if m := _LINE.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[3])], m[4], float(m[5])))]
            rules[Rule(tuple(sorted({c for _, c in path})))] = None
    return list(rules)


def training_rows(measured: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The bounded sample of labelled rows that are not held out: STATISTICS and label."""
    known = labels.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("_mean")).filter("_mean IS NOT NULL")
    rows = measured.filter(~held_out(F.col("doc_id"))).join(known, "doc_id")
    order = F.crc32(F.concat_ws("/", F.lit(str(SEED)), F.col("doc_id").cast("string")))
    chosen = rows.select("doc_id", order.alias("_order"), (F.col("_mean") >= 0.5).cast("double").alias("label"), *STATISTICS)
    return chosen.orderBy("_order", "doc_id", *STATISTICS).limit(sample_rows)


def fit(rows: DataFrame) -> RuleEnsemble:
    """Rules and weights from the rows of ``training_rows``."""
    rows = stored(rows.select("label", *STATISTICS).coalesce(1), "quality-sample")
    total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < total:
        share = min(max(ones / total if total else 0.5, 1e-6), 1 - 1e-6)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="sqrt", minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = tree_rules(forest.toDebugString, STATISTICS)
    if not rules:
        return RuleEnsemble(math.log(ones / (total - ones)), ())
    fired = rows.select("label", array_to_vector(F.array(*[r.column() for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=200).fit(fired)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return RuleEnsemble(float(lasso.intercept), tuple(weights))


def model_of(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """A model fitted on these documents and labels."""
    measured = statistics(docs.select("doc_id", column(text).alias("text"))).select("doc_id", *STATISTICS)  # no text in the join
    return fit(training_rows(measured, labels, label, sample_rows))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with held_out, score and predicted, by a model fitted on these documents and labels."""
    model = model_of(docs, labels, text, label, sample_rows)
    source = without(docs, ["held_out", "score", "predicted"])
    names = fresh(docs, *STATISTICS)
    out = statistics(source, text, names).withColumn("score", model.score(names))
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")}).drop(*names.values())


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents predicted to be of label 1, with their own columns."""
    model = model_of(docs, labels, text, label, sample_rows)
    names = fresh(docs, *STATISTICS, "score")
    out = statistics(docs, text, names).withColumn(names["score"], model.score(names))
    # A filter on a plain column would be pushed below the statistics and repeat them for every rule of the model;
    # past a non-deterministic column it is not.
    once = F.when(F.spark_partition_id() >= 0, F.col(names["score"]))
    return out.withColumn(names["score"], once).filter(F.col(names["score"]) >= 0.5).select(*map(column, docs.columns))
