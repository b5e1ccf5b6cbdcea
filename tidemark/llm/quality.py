"""A quality classifier: a sparse ensemble of rules over text statistics.

The statistics of every whole text are Spark columns.  A small random forest is
grown on labelled rows; every path from a root to a node is a conjunctive rule.  A
lasso-penalised logistic regression over the rules keeps few of them, and these
become one Spark column expression that scores all documents.

The fit reads labelled rows outside the held-out fold, at most ``FIT_ROWS`` of them
(chosen by a hash of the id); labels, language, source and id are not statistics.

Defined cases: null text counts as empty and gets a score; a null id is held out;
without labelled rows of both classes every score is the smoothed share of label 1;
labels may repeat, and an id with both labels counts as a row of each; a text of any
length gets its statistics from all of it; repeated documents are rows of their own and
scored alike, also with the same id; columns of the documents other than id and text,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, held_out, load, written

FIT_ROWS, TREES, DEPTH, LASSO, CUT = 40_000, 16, 3, 0.001, 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one whole text, all defined for the empty one."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    length = F.length(text).cast("double")
    lines, words = F.split(text, "\n"), F.split(text, " ")
    return {
        "chars": length,
        "words": count(WORD),
        "upper": over(count(r"\p{Lu}"), length),
        "marks": over(count(r"[^\p{L}\p{N}\s]"), length),
        "digits": over(count(r"\p{N}"), length),
        "doubled_marks": over(count(r"([!-/:-@\[-`{-~])\1"), length),
        "bars": over(count(r"[|<>{}=\\]"), length),
        "sentence_ends": over(count(r"[.?](?=\s|$)"), length),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "word_length": over(length, count(WORD)),
    }


def tree_rules(forest, names: list[str]) -> list[tuple]:
    """Every path of every tree as a sorted tuple of (statistic, "<=" or ">", threshold)."""
    rules = set()

    def walk(node, path):
        if path:
            rules.add(tuple(sorted(path)))
        if node.getClass().getSimpleName() == "InternalNode":
            name, at = names[node.split().featureIndex()], node.split().threshold()
            walk(node.leftChild(), [*path, (name, "<=", at)])
            walk(node.rightChild(), [*path, (name, ">", at)])

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), [])
    return sorted(rules)


def holds(rule: tuple) -> Column:
    out = F.lit(True)
    for name, op, at in rule:
        out = out & (F.col(name) <= at if op == "<=" else F.col(name) > at)
    return out


class RuleModel:
    """Weighted rules and an intercept, or a constant."""

    def __init__(self, intercept: float, weighted: list[tuple[float, tuple]]):
        self.intercept, self.weighted = intercept, weighted

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame, names: list[str], seed: int = 11) -> RuleModel:
    """labelled: the statistics and a column label of 0.0 and 1.0."""
    by_class = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(by_class) < 2:
        import math

        ones, all_rows = by_class.get(1.0, 0), sum(by_class.values())
        return RuleModel(math.log((ones + 1) / (all_rows - ones + 1)), [])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(labelled)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = tree_rules(forest, names)
    columns = {f"r{i}": holds(r).cast("double") for i, r in enumerate(rules)}
    table = labelled.select("label", *[c.alias(k) for k, c in columns.items()])
    table = VectorAssembler(inputCols=list(columns), outputCol="features").transform(table).select("label", "features")
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60, standardization=False).fit(table)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-4])


def score(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every document."""
    stats = statistics(F.col(text_col))
    names = list(stats)
    table = written(docs.select(F.col(id_col).alias("__tm_id"), *[c.alias(k) for k, c in stats.items()]), "statistics")
    marks = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, modulus, remainder)).select(F.col(id_col).alias("__tm_id"), F.col(label_col).cast("double").alias("label")).distinct()
    n = marks.count()
    share = min(1.0, FIT_ROWS / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64("__tm_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    model = fit(written(table.join(marks, "__tm_id"), "labelled"), names)
    return table.select(F.col("__tm_id").alias(id_col), held_out("__tm_id", modulus, remainder).alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), 4, 2)


SQL: dict = {}
