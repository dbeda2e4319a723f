"""Evaluation measures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micro_f1(df: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """keys, f1: micro-F1 over the classes that were predicted at all within the keys.

    2 TP / (2 TP + FP + FN); a miss counts as a false negative only if its label was predicted somewhere.
    """
    predicted = df.select(*keys, F.col(pred).alias("_class")).distinct()
    marked = df.join(predicted.withColumn("_known", F.lit(True)), on=[*[df[k].eqNullSafe(predicted[k]) for k in keys], df[label] == predicted["_class"]], how="left").select(*[df[k] for k in keys], df[label].alias("_y"), df[pred].alias("_p"), "_known")
    tp = F.sum(F.when(F.col("_y") == F.col("_p"), 1).otherwise(0))
    fp = F.sum(F.when(F.col("_y") != F.col("_p"), 1).otherwise(0))
    fn = F.sum(F.when((F.col("_y") != F.col("_p")) & F.col("_known"), 1).otherwise(0))
    return marked.groupBy(*keys).agg((2 * tp / (2 * tp + fp + fn)).alias("f1"))


def accuracy(df: DataFrame, keys: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def label_entropy(labels) -> Column:
    """Entropy of an array of labels to the base of its number of classes; 0 for one class or none."""
    classes = F.array_distinct(labels)
    share = lambda c: F.size(F.filter(labels, lambda x: x == c)) / F.size(labels)
    total = F.aggregate(F.transform(classes, lambda c: -share(c) * F.log(share(c))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(classes) <= 1, F.lit(0.0)).otherwise(total / F.log(F.size(classes)))
