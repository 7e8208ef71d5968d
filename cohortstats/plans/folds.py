"""Contiguous k-folds within each site, as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadUserInput
from .cohort import SITE
from .stable import settle


def with_fold(df: DataFrame, n_splits: int, order: str, site: str = SITE) -> DataFrame:
    """Adds ``fold``: rows of a site in the order of ``order``, cut into n_splits runs of which the first
    (n mod k) have one row more.

    The place of a row is its rank among its site's rows. It comes from a distributed rank: rows are
    range-partitioned by (site, order), counted within partitions, and the partitions' offsets (a few
    numbers each) are added, so no site is gathered in one task as a window would do. The numbered
    rows are settled first: a partition that is computed again could hold other rows.
    """
    if n_splits < 2:
        raise BadUserInput("n_splits must be at least 2.")
    site_col = F.col(site) if site in df.columns else F.lit("")
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.withColumn("__site", site_col).repartitionByRange(parts, "__site", order).sortWithinPartitions("__site", order)
    numbered = spread.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % F.lit(1 << 33))
    numbered = settle(numbered)
    groups = numbered.groupBy("__site", "__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()
    before: dict = {}
    rows = []
    for g in sorted(groups, key=lambda g: (str(g["__site"]), g["__part"])):
        done = before.get(g["__site"], 0)
        rows.append((g["__site"], g["__part"], done - g["first"]))
        before[g["__site"]] = done + g.n
    for s, n in before.items():
        if n < n_splits:
            raise BadUserInput(f"Cross validation needs at least {n_splits} rows in each site; {s or 'the data'} has {n}.")
    schema = numbered.select("__site", "__part").schema.simpleString()
    shift = df.sparkSession.createDataFrame([(*r, before[r[0]]) for r in rows], schema.replace("struct<", "").rstrip(">").replace(":", " ") + ", __shift long, __n long")
    joined = numbered.join(F.broadcast(shift), ["__site", "__part"])
    return joined.withColumn("fold", fold_of(F.col("__at") + F.col("__shift"), F.col("__n"), n_splits)).drop("__site", "__part", "__at", "__shift", "__n")


def fold_of(place, n, k: int):
    """Fold of the 0-based place among n rows."""
    q, r = F.floor(n / k), n % k
    edge = r * (q + 1)
    return F.when(place < edge, F.floor(place / (q + 1))).otherwise(r + F.floor((place - edge) / F.greatest(q, F.lit(1)))).cast("int")


def with_fold_window(df: DataFrame, n_splits: int, order: str, site: str = SITE) -> DataFrame:
    """The same by a window over each site: one lazy plan, for sites that fit a task."""
    w = Window.partitionBy(site)
    place = F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("fold", fold_of(place, F.count("*").over(w), n_splits))
