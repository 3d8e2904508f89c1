"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. Statistics of a text are Spark column expressions.
2. Shallow random-forest trees are grown on labelled rows; every path from a
   root to a node becomes one rule, a conjunction of interval conditions.
3. A logistic model with a lasso penalty over the rules (as 0/1 columns)
   leaves most of them without weight.
4. The rules that keep a weight are compiled into one Spark column, so scoring
   a table is a scan without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A rule is a set of (statistic, lower bound exclusive, upper bound inclusive).
Rule = frozenset[tuple[str, float, float]]


def statistics() -> dict[str, Column]:
    """Statistics over ``__text`` (not null), ``__words`` and ``__lines``; an empty text has finite values too."""
    def left(pattern: str) -> Column:  # code points that are not in a run of the pattern
        return F.char_length(F.regexp_replace("__text", pattern, ""))

    chars = F.greatest(F.char_length("__text"), F.lit(1))
    words = F.greatest(F.size("__words"), F.lit(1))
    return {
        "n_chars": F.char_length("__text").cast("double"),
        "n_words": F.size("__words").cast("double"),
        "word_length": chars / words,
        "distinct_words": F.size(F.array_distinct("__words")) / words,
        "distinct_lines": F.size(F.array_distinct("__lines")) / F.greatest(F.size("__lines"), F.lit(1)),
        "words_per_line": words / F.greatest(F.size("__lines"), F.lit(1)),
        "upper_share": left(r"\P{Lu}+") / chars,
        "digit_share": left(r"\P{Nd}+") / chars,
        "symbol_share": left(r"[\p{L}\p{M}\p{N}\s]+") / chars,
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """(row struct of all input columns, stats struct) per input row."""
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select("__row", "__text", F.split(F.trim("__text"), r"\s+").alias("__words"), F.split("__text", "\n").alias("__lines"))
    return rows.select(F.col("__row").alias("row"), F.struct(*(c.cast("double").alias(n) for n, c in statistics().items())).alias("stats"))


def held_out() -> Column:
    """Rows never learnt from: CRC-32 of the doc_id as text, modulo 3, is 1 (a missing doc_id is never held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def holds(rule: Rule, stat=lambda n: F.col(f"stats.{n}")) -> Column:
    """The rule as a boolean column."""
    out = None
    for name, low, high in sorted(rule):
        for bound, test in ((low, stat(name) > low), (high, stat(name) <= high)):
            if math.isfinite(bound):
                out = test if out is None else out & test
    return out


def tree_paths(description: str, names: list[str]) -> set[Rule]:
    """Every path of every tree in a forest's ``toDebugString`` as a rule."""
    rules, path = set(), []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if re.match(r"\s*Tree ", line):
                path = []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, sign, value in path:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (max(low, value), high) if sign == ">" else (low, min(high, value))
        rules.add(frozenset((n, *b) for n, b in bounds.items()))
    return rules


@dataclass
class RuleModel:
    """An intercept and weighted rules; ``score`` is the compiled column over ``stats``."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """The lambda binds the statistics once, so a filter on the score cannot copy them into every rule."""
        def of(stats: Column) -> Column:
            total = F.lit(self.intercept)
            for rule, weight in sorted(self.weights.items(), key=lambda x: sorted(x[0])):
                total = total + F.when(holds(rule, lambda n: stats[n]), F.lit(weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

        return F.transform(F.array("stats"), of)[0]


def lasso(rows: DataFrame, penalty: float, rounds: int = 30, tolerance: float = 1e-4) -> tuple[float, list[float]]:
    """(intercept, weights) of the logistic model over ``rows`` (label 0.0 and 1.0, features) that minimises mean loss
    plus ``penalty`` times the absolute weights of the standardised features.

    Newton steps until one changes that sum by less than ``tolerance`` of it: each is a weighted linear lasso, for
    which Spark reads the rows once and sums products of pairs of features; its descent is on these sums.  A gradient
    method runs a job, with broadcasts that take a 4 MB buffer in the driver each, for each of its some 180
    evaluations; Newton steps are about ten.  Where they do not descend, the gradient method is used.
    """
    scaler = StandardScaler(inputCol="features", outputCol="scaled").fit(rows)
    spread = scaler.std.toArray().tolist()
    scaled = scaler.transform(rows).select("label", F.col("scaled").alias("features"))
    n, share = scaled.agg(F.count("*"), F.avg("label")).first()
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("eta")))
    near = F.greatest(p * (F.lit(1.0) - p), F.lit(1e-5))  # the step's weight; the floor moves no fixed point
    loss = F.greatest("eta", F.lit(0.0)) - F.col("eta") * F.col("label") + F.log1p(F.exp(-F.abs("eta")))
    found = (math.log(share / (1 - share)), [0.0] * len(spread))
    at, least, best = scaled.withColumn("eta", F.lit(found[0])), math.inf, found
    for _ in range(rounds):
        total, now = at.agg(F.sum(near), F.avg(loss)).first()
        now += penalty * sum(map(abs, found[1]))
        if not now <= least * (1 + tolerance):
            break
        if least - now <= tolerance * now:
            intercept, weights = found if now < least else best
            return intercept, [w / s if s else 0.0 for w, s in zip(weights, spread)]
        least, best = now, found
        step = LinearRegression(solver="normal", elasticNetParam=1.0, regParam=penalty * n / total, standardization=False,
                                labelCol="target", weightCol="near", maxIter=1000, tol=1e-10)
        model = step.fit(at.select("features", near.alias("near"), (F.col("eta") + (F.col("label") - p) / near).alias("target")))
        found = (model.intercept, model.coefficients.toArray().tolist())
        at = model.transform(scaled).withColumnRenamed("prediction", "eta")
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(rows)
    return model.intercept, model.coefficients.toArray().tolist()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 30, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    """Learn from at most ``max_rows`` labelled documents that are not held out.

    The sample is the ids with the smallest hashes, so it does not depend on
    order or partitions and is broadcast with a known bound.  Labels that are
    null, or that disagree for one doc_id, are not used.  With no label, or
    one class only, the model is the smoothed share of label 1.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    ids = ids.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    sample = ids.select("doc_id", F.col("low").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = with_statistics(texts).select("row.doc_id", F.col("row.label").cast("double").alias("label"), "stats")
    rows = stored(rows.repartition(1).sortWithinPartitions("doc_id"), "labelled-statistics")  # max_rows rows of numbers
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        ones, n = seen.get(1.0, 0), sum(seen.values())
        return RuleModel(math.log((ones + 1) / (n - ones + 1)), {})
    names = list(statistics())
    vectors = rows.select("label", "stats", array_to_vector(F.array(*(F.col(f"stats.{n}") for n in names))).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(vectors)
    rules = sorted(tree_paths(forest.toDebugString, names), key=sorted)
    flags = rows.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features"))
    intercept, weights = lasso(stored(flags, "rule-flags"), penalty)
    return RuleModel(intercept, {r: float(w) for r, w in zip(rules, weights) if w})


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """One row per input row: row (a struct of all its columns), held_out, score, predicted (1 from 0.5 on).

    Only the text enters the score; null counts as empty."""
    scored = with_statistics(docs).withColumn("score", model.score())
    held = scored.withColumn("doc_id", F.col("row.doc_id")).withColumn("held_out", held_out())
    return held.select("row", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
