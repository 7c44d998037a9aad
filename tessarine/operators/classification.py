"""Classification metrics from scores and 0/1 labels.

Rows with a null score or label count nowhere. Equal scores are one level, so ties make no difference to the area or the precision. A rate
without a divisor is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """One row of counts and rates at a threshold; predicted positive if score >= threshold. Undefined rates are null."""
    hit = F.col("score") >= threshold
    n = lambda c: F.count(F.when(c, 1))
    sums = rows.agg(n(hit & (F.col("y") == 1)).alias("tp"), n(hit & (F.col("y") == 0)).alias("fp"), n(~hit & (F.col("y") == 1)).alias("fn"), n(~hit & (F.col("y") == 0)).alias("tn"))
    ratio = lambda a, b: F.expr(f"try_divide({a}, {b})")
    mcc = F.expr("try_divide(cast(tp as double) * tn - cast(fp as double) * fn, sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)))")
    return sums.select(
        "tp", "fp", "fn", "tn", ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"), ratio("tp", "tp + fp").alias("precision"), ratio("tp", "tp + fn").alias("recall"),
        ratio("tn", "tn + fp").alias("specificity"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"), ratio("tp", "tp + fp + fn").alias("threat"), mcc.alias("mcc"),
    )


#: Rates from counts as doubles, in SQL that Spark and DuckDB read alike.
RATES = {
    "false_positive_rate": "fp / (fp + tn)",
    "false_negative_rate": "fn / (fn + tp)",
    "false_discovery_rate": "fp / (fp + tp)",
    "false_omission_rate": "fn / (fn + tn)",
    "negative_predictive_value": "tn / (tn + fn)",
    "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "prevalence": "(tp + fn) / (tp + fp + fn + tn)",
    "informedness": "tp / (tp + fn) + tn / (tn + fp) - 1",
    "markedness": "tp / (tp + fp) + tn / (tn + fn) - 1",
    "fowlkes_mallows": "sqrt(tp / (tp + fp) * tp / (tp + fn))",
    "g_mean": "sqrt(tp / (tp + fn) * tn / (tn + fp))",
    "positive_likelihood_ratio": "(tp / (tp + fn)) / (fp / (fp + tn))",
    "negative_likelihood_ratio": "(fn / (tp + fn)) / (tn / (fp + tn))",
    "diagnostic_odds_ratio": "(tp * tn) / (fp * fn)",
    "prevalence_threshold": "sqrt(fp / (fp + tn)) / (sqrt(tp / (tp + fn)) + sqrt(fp / (fp + tn)))",
    "cohen_kappa": "2 * (tp * tn - fn * fp) / ((tp + fp) * (fp + tn) + (tp + fn) * (fn + tn))",
    "f2": "5 * tp / (5 * tp + 4 * fn + fp)",
    "f_half": "1.25 * tp / (1.25 * tp + 0.25 * fn + fp)",
}


def rates(rows: DataFrame, threshold: float) -> DataFrame:
    """One row of all RATES at a threshold; null where a divisor is zero."""
    counts = confusion(rows, threshold).select(*(F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")))
    return counts.select(*(F.expr(_safe(sql)).alias(name) for name, sql in RATES.items()))


def top_indicator_rates(rows: DataFrame) -> DataFrame:
    """All RATES, counts, accuracy, precision, recall and the like where as many of the highest scores are taken for true as rows are (y = 1); of equal scores at the border a share is."""
    x = _levels(rows)
    true = x.agg(F.sum("p").alias("all_p"))
    # scores wholly among the first P rows count in full, those at the border by the share that is left
    taken = x.crossJoin(F.broadcast(true)).withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("all_p") - (F.col("tp") + F.col("fp") - F.col("p") - F.col("n"))) / (F.col("p") + F.col("n")))))
    sums = taken.agg(F.sum(F.col("p") * F.col("share")).alias("tp"), F.sum(F.col("n") * F.col("share")).alias("fp"), F.sum(F.col("p") * (1 - F.col("share"))).alias("fn"), F.sum(F.col("n") * (1 - F.col("share"))).alias("tn"))
    more = {"accuracy": "(tp + tn) / (tp + fp + fn + tn)", "precision": "tp / (tp + fp)", "recall": "tp / (tp + fn)", "specificity": "tn / (tn + fp)", "f1": "2 * tp / (2 * tp + fp + fn)", "threat": "tp / (tp + fp + fn)"}
    mcc = F.expr("try_divide(tp * tn - fp * fn, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))")
    return sums.select("tp", "fp", "fn", "tn", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("scores"), mcc.alias("mcc"), *(F.expr(_safe(sql)).alias(name) for name, sql in (RATES | more).items()))


def _safe(sql: str) -> str:
    """The rate with null for a division by zero, which Spark's ANSI mode raises: every divisor in nullif(..., 0)."""
    out, i = "", 0
    while i < len(sql):
        if sql[i] != "/":
            out, i = out + sql[i], i + 1
            continue
        i = end = i + 2
        if sql[i] == "(":
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
                if not depth:
                    break
        else:
            while end < len(sql) and (sql[end].isalnum() or sql[end] == "_"):
                end += 1
        out, i = f"{out}/ nullif({_safe(sql[i:end])}, 0)", end
    return out


def _levels(rows: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score and above it. Ties meet in one row first, so the running sums are over
    scores, by ranges: totals of each range, then places within."""
    from ..sources.staging import staged

    level = rows.where("score is not null and y is not null").groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    level = staged(level.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    parts = level.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("pp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"))
    inner = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = level.withColumn("cp", F.sum("p").over(inner)).withColumn("cn", F.sum("n").over(inner)).join(parts, "part")
    return placed.select("score", "p", "n", (F.col("cp") + F.col("p0")).alias("tp"), (F.col("cn") + F.col("n0")).alias("fp"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision."""
    x = _levels(rows)
    sums = x.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("p") * (F.col("fp") - F.col("n") / 2)).alias("below"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return sums.select((1 - F.try_divide("below", F.col("P") * F.col("N"))).alias("roc_auc"), F.try_divide("ap", "P").alias("average_precision"))
