"""ROC points of a score, by running sums over its sorted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stable import settle


def roc_curve(df: DataFrame, score: str, target: str) -> DataFrame:
    """threshold, tp, fp, tpr and fpr at every distinct score, highest first.

    Rows are first summed by score. The distinct scores are range-partitioned, accumulated within
    partitions, and the partitions' sums (two numbers each) are added, so they never gather in one task.
    """
    counted = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(target).cast("long")).alias("p"), F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = settle(counted.repartitionByRange(parts, F.desc("threshold")).withColumn("__part", F.spark_partition_id()))
    sums = spread.groupBy("__part").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).orderBy("__part").collect()
    rows, p, n = [], 0, 0
    for r in sums:
        rows.append((r["__part"], p, n))
        p, n = p + r.p, n + r.n
    before = df.sparkSession.createDataFrame(rows, "__of int, __p long, __n long")
    w = Window.partitionBy("__part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = spread.withColumns({"tp": F.sum("p").over(w), "all": F.sum("n").over(w)}).join(F.broadcast(before), F.col("__part") == F.col("__of"))
    tp, fp = F.col("tp") + F.col("__p"), F.col("all") - F.col("tp") + F.col("__n") - F.col("__p")
    rate = lambda a, b: a / F.lit(float(b)) if b else F.lit(0.0)
    return run.select("threshold", tp.alias("tp"), fp.alias("fp"), rate(tp, p).alias("tpr"), rate(fp, n - p).alias("fpr"))
