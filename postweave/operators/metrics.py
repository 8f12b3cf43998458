"""Quality of a binary edge classifier, in one pass over the scored edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postweave.storage import materialize


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts of the four outcomes with accuracy, precision, recall and F1."""
    truth, guess = F.col(label) == 1, F.col(prediction) == 1
    counts = scored.agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & guess).alias("fp"))
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    total = F.col("tp") + F.col("tn") + F.col("fn") + F.col("fp")
    return counts.withColumns({
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), total),
        "precision": precision, "recall": recall,
        "f1": F.try_divide(precision * recall * 2, precision + recall)})


def auroc(scored: DataFrame, score: Column, label: str = "label") -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order.

    Counted per distinct score, ties as one half, so no rank over single rows is needed.
    """
    by_score = scored.groupBy(score.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = running_total(by_score, "score", "neg", "below")
    return below.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)),
                     (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


# Bins that scores between 0 and 1 are counted in.
BINS = 1000


def precision_recall(scored: DataFrame, score: Column, label: str = "label", bins: int = BINS) -> DataFrame:
    """``(bin, threshold, tp, fp, precision, recall)`` if scores from each threshold on count as positive.

    Scores between 0 and 1 are counted per bin in one pass; only bins that occur are listed, so what is summed
    up in order are at most ``bins`` rows. Rows without a score are left out.
    """
    place = F.least(F.floor(F.round(score * bins, 6)), F.lit(bins - 1)).cast("int")
    counts = scored.filter(score.isNotNull()).groupBy(place.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))
    every = Window.partitionBy(F.lit(0))
    summed = counts.select(
        "bin", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(every).alias("all"))
    return summed.select(
        "bin", (F.col("bin") / bins).alias("threshold"), "tp", "fp",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", F.col("all")).alias("recall"))


def threshold_for_recall(curve: DataFrame, least: float) -> float:
    """The largest threshold of ``precision_recall`` that reaches a recall; 0 if none does."""
    found = curve.filter(F.col("recall") >= least).agg(F.max("threshold")).first()[0]
    return 0.0 if found is None else found


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key``, without a one-task window.

    Rows are range-partitioned by their key and stored; a window runs inside each partition, and the sums
    of the partitions before it, one row each, are added. ``key`` is unique.
    """
    ranged = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn(
        "range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("range").agg(F.sum(value).alias("in_range"))
    # One row per partition of the plan.
    ahead = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(bases), "range")
        .withColumn(name, F.col("base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("range", "base")
    )
