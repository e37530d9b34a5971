"""Quality classification by a sparse ensemble of rules (RuleFit: Friedman & Popescu).

Statistics of a text are Spark columns.  Shallow trees, fitted on labelled rows, give conjunctive rules: every path
from a root.  A logistic regression with a lasso penalty keeps few of them, and these are compiled into one column
expression, so that scoring is a projection without any Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.common import WORD, others, quoted, text_of
from lodgelens.session import StoredTables

TRAIN_ROWS = 30_000  # labelled rows that the fit uses at most, those with the smallest hash of their id
TREES = 12
DEPTH = 3
LASSO = 0.001
CUT = 0.3
SEED = 5


def statistics(text: Column) -> dict[str, Column]:
    """The statistics rules are made of; shares are per word, and all are 0 for an empty text."""
    words = F.regexp_count(text, F.lit(WORD))
    n = F.greatest(words, F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    blank_split = F.split(text, " ")

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    return {
        "log_words": F.log1p(words.cast("double")),
        "word_length": F.length(text) / n,
        "capitals": share("[A-Z]"),
        "capital_words": share(r"\b[A-Z]{2,}\b"),
        "symbols": share(r"[#$%&*@^~<>={}_\\]"),
        "exclamations": share("!"),
        "bars": share(r"\|"),
        "digits": share("[0-9]"),
        "stops": share("[.]"),
        "commas": share(","),
        "lines": F.when(F.length(text) > 0, F.size(lines)).otherwise(0) / n,
        "new_words": F.when(F.length(text) > 0, F.size(F.array_distinct(blank_split)) / F.size(blank_split)).otherwise(0.0),
        "new_lines": F.when(F.length(text) > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0),
    }


Condition = tuple[str, str, float]  # statistic, "<=" or ">", bound


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; a rule is a tuple of conditions that must all hold."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def score(self) -> Column:
        """The probability of label 1, from columns named like the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, side, bound in rule:
        out = out & (F.col(name) <= bound if side == "<=" else F.col(name) > bound)
    return out


def tree_rules(description: str, names: list[str]) -> list[tuple[Condition, ...]]:
    """The paths of a tree, from Spark ML's printed form: one rule per node below the root."""
    path: list[tuple[int, Condition]] = []
    rules = []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (names[int(found[2])], found[3], float(found[4]))))
        rules.append(tuple(sorted({condition for _, condition in path})))
    return rules


def fit_rules(labelled: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Fit on columns ``names`` and ``label`` (0 or 1).  With one class only, or no rows, the model is its smoothed share."""
    counts = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
    yes, no = counts.get(1, 0), counts.get(0, 0)
    if not yes or not no:
        return RuleModel(math.log((yes + 1) / (no + 1)), ())
    rows = labelled.select(
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.array(*[F.col(n).cast("double") for n in names])).alias("features"),
        *names,
    )
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=SEED).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString, names)})
    if not rules:
        return RuleModel(math.log((yes + 1) / (no + 1)), ())
    holds = array_to_vector(F.array(*[rule_column(rule).cast("double") for rule in rules]))
    lasso_fit = LogisticRegression(
        regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=False, featuresCol="holds"
    ).fit(rows.select("label", holds.alias("holds")))
    weights = lasso_fit.coefficients.toArray().tolist()
    return RuleModel(float(lasso_fit.intercept), tuple((w, rule) for w, rule in zip(weights, rules) if w))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    label: str = "quality",
    train_rows: int = TRAIN_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or the columns ``carry``) with ``score`` (probability of label 1) and ``predicted`` (score >= CUT).

    ``train`` says which rows of ``docs`` may be learned from; their labels are those of ``labels`` with the same
    doc_id (several count each, null ones not at all).  A null text is empty and gets a score like any other.  Rows
    that repeat an id are scored each; an empty table gives no rows.  Input columns named like a result are replaced.
    """
    store = StoredTables(docs.sparkSession, "quality")
    names = list(statistics(F.lit("")))
    kept = docs.select(*(docs.columns if carry is None else carry))
    columns = F.struct(*[quoted(n).alias(n) for n in others(kept, ("score", "predicted"))])
    measured = store.put(
        docs.select(columns.alias("row"), F.col("doc_id").alias("id"), train.alias("train"), text_of().alias("text"))
        .select("row", "id", "train", *[column.alias(n) for n, column in statistics(F.col("text")).items()]),
        "measured",
    )
    known = labels.where(F.col(label).isNotNull()).select(
        F.col("doc_id").alias("label_id"), (F.col(label) > 0).cast("int").alias("label")
    )
    joined = measured.where("train").join(known, F.col("id") == F.col("label_id"))
    sample = store.put(
        joined.select("label", *names, F.xxhash64("id").alias("order")).orderBy("order", *names).limit(train_rows), "sample"
    )
    model = fit_rules(sample, names)
    scored = measured.withColumn("score of the row", model.score())
    return scored.select(
        "row.*",
        F.col("score of the row").alias("score"),
        (F.col("score of the row") >= CUT).cast("int").alias("predicted"),
    )
