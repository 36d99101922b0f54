"""A boosted-tree classifier over a feature table, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.aggregates import is_constant

#: Thresholds that are tried, besides 0.
THRESHOLDS = 100


def train_classifier(train: DataFrame, features: Sequence[str], target: str):
    """Boosted trees of depth 2 with step 1 on a 0/1 target; refuses a target with one value. Returns a pipeline model.

    Boosting lessens the log loss, which may cost errors: the threshold is therefore the one with the fewest errors on the
    training rows, and as 0 and 1 are among those tried, there are no more of them than with the better constant.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    if is_constant(train, target).first()["constant"]:
        raise ValueError(f"{target} has one value only: nothing to learn")
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    trees = GBTClassifier(labelCol=target, featuresCol="features", maxDepth=2, stepSize=1.0, maxIter=10, seed=1)
    fitted = Pipeline(stages=[assemble, trees]).fit(train)
    t = best_threshold(fitted.transform(train), target)
    fitted.stages[-1].setThresholds([1 - t, t])
    return fitted


def best_threshold(scored: DataFrame, target: str, steps: int = THRESHOLDS) -> float:
    """Of the thresholds 0 to 1, steps in number and 0.5 among them, the one with the fewest errors; of equal ones that
    next to 0.5. Rows are counted by score first, and trees have few scores however many the rows."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    # One row per score: trees cut each feature in a few places.
    counts = scored.groupBy(p[0].alias("p0"), p[1].alias("p1")).agg(F.sum((F.col(target) == 1).cast("long")).alias("ones"), F.sum((F.col(target) == 0).cast("long")).alias("zeros"))
    t = F.col("k") / F.lit(steps)
    # As the model decides: the larger of both probabilities, each divided by its threshold; 0 stands for any size.
    scaled = [F.when(s == 0, F.lit(float("inf"))).otherwise(p / F.when(s != 0, s)) for p, s in ((F.col("p0"), 1 - t), (F.col("p1"), t))]
    wrong = F.sum(F.when(scaled[1] > scaled[0], F.col("zeros")).otherwise(F.col("ones")))
    tried = counts.crossJoin(F.broadcast(scored.sparkSession.range(steps + 1).toDF("k")))  # a constant number of rows
    best = tried.groupBy("k").agg(wrong.alias("wrong")).orderBy("wrong", F.abs(F.col("k") * 2 - steps), "k").first()
    return best["k"] / steps


def evaluate(test: DataFrame, model, target: str) -> DataFrame:
    """(target, prediction, abs_error) for each row."""
    return errors(model.transform(test), target, F.col("prediction"))


def errors(df: DataFrame, target: str, prediction: Column) -> DataFrame:
    return df.select(F.col(target).alias("target"), prediction.alias("prediction")).withColumn("abs_error", F.abs(F.col("target") - F.col("prediction")))
