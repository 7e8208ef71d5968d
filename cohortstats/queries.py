"""Harness queries over the driver's tables, each with its SQL.

The tables stand in for a data model: l_returnflag, o_orderpriority and the like are data sets,
three logical sites hold them. Floats are rounded on both sides, as sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import anova, correlation, descriptive, federated, kmeans, moments, naive_bayes, regression, roc, ttests
from .plans import cohort, folds, landscape, longitudinal
from .plans.cohort import InputData
from .plans.rounds import Round
from .sources import csv_models
from .streaming import statistics as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- the stand-in cohorts


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SITE_SQL = "CASE l_returnflag WHEN 'A' THEN 's1' WHEN 'N' THEN 's2' ELSE 's3' END"


def items(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with data set, site and a column that has nulls."""
    site = F.when(F.col("l_returnflag") == "A", "s1").when(F.col("l_returnflag") == "N", "s2").otherwise("s3")
    return table(spark, d, "lineitem").withColumns({"dataset": F.col("l_returnflag"), "site": site, "discount": F.nullif("l_discount", F.lit(0.0))})


def orders(spark: SparkSession, d: str) -> DataFrame:
    site = F.when(F.col("o_orderpriority") < "2", "s1").when(F.col("o_orderpriority") < "4", "s2").otherwise("s3")
    return table(spark, d, "orders").withColumns({"dataset": F.col("o_orderpriority"), "site": site})


ITEMS = f"(SELECT *, l_returnflag AS dataset, {SITE_SQL} AS site, nullif(l_discount, 0.0) AS discount FROM lineitem)"
ORDERS = "(SELECT *, o_orderpriority AS dataset, CASE WHEN o_orderpriority < '2' THEN 's1' WHEN o_orderpriority < '4' THEN 's2' ELSE 's3' END AS site FROM orders)"


def rows_of(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(None if v is None else float(v) if isinstance(v, (float, np.floating)) else v for v in r) for r in values], schema)


def r6(x) -> float:
    return round(float(x), 6) + 0.0


# ---- filters

LEAF = {
    "equal": ("l_quantity", 25, "l_quantity = 25"),
    "not_equal": ("discount", 0.05, "discount <> 0.05"),
    "less": ("l_quantity", 10, "l_quantity < 10"),
    "greater": ("l_extendedprice", 50000, "l_extendedprice > 50000"),
    "less_or_equal": ("l_quantity", 10, "l_quantity <= 10"),
    "greater_or_equal": ("l_tax", 0.04, "l_tax >= 0.04"),
    "between": ("l_quantity", [5, 15], "l_quantity BETWEEN 5 AND 15"),
    "not_between": ("discount", [0.02, 0.06], "NOT discount BETWEEN 0.02 AND 0.06"),
    "is_null": ("discount", None, "discount IS NULL"),
    "is_not_null": ("discount", None, "discount IS NOT NULL"),
    "in": ("l_returnflag", ["A", "R"], "l_returnflag IN ('A', 'R')"),
    "not_in": ("discount", [0.01, 0.02, 0.03], "discount NOT IN (0.01, 0.02, 0.03)"),
}
NESTED = {
    "condition": "AND",
    "rules": [
        {"id": "l_quantity", "operator": "between", "value": [5, 45]},
        {"condition": "OR", "rules": [{"id": "l_returnflag", "operator": "equal", "value": "A"}, {"condition": "AND", "rules": [{"id": "l_tax", "operator": "greater", "value": 0.03}, {"id": "discount", "operator": "not_equal", "value": 0.05}]}]},
    ],
}


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def _add_filters() -> None:
    for op, (column, value, sql) in LEAF.items():
        data = InputData(y=("l_linestatus", "l_quantity"), filters={"id": column, "operator": op, "value": value})
        query(f"filter_{op}", f"SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM {ITEMS} WHERE {sql} GROUP BY 1")(lambda s, d, data=data: _counted(cohort.select_rows(items(s, d), data, keep=())))


_add_filters()


@query("filter_nested_and_or", f"SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM {ITEMS} WHERE l_quantity BETWEEN 5 AND 45 AND (l_returnflag = 'A' OR (l_tax > 0.03 AND discount <> 0.05)) GROUP BY 1")
def filter_nested(s, d):
    return _counted(cohort.select_rows(items(s, d), InputData(y=("l_linestatus", "l_quantity"), filters=NESTED), keep=()))


@query("filter_null_semantics", f"SELECT 'ne' AS op, count(*) AS n FROM {ITEMS} WHERE discount <> 0.05 UNION ALL SELECT 'nb', count(*) FROM {ITEMS} WHERE NOT discount BETWEEN 0.02 AND 0.06 UNION ALL SELECT 'ni', count(*) FROM {ITEMS} WHERE discount NOT IN (0.05)")
def filter_nulls(s, d):
    t = items(s, d)
    parts = [(n, {"id": "discount", "operator": op, "value": v}) for n, op, v in (("ne", "not_equal", 0.05), ("nb", "not_between", [0.02, 0.06]), ("ni", "not_in", [0.05]))]
    return t.agg(*[F.count_if(F.coalesce(cohort.rules.to_column(f), F.lit(False))).alias(n) for n, f in parts]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("op"), F.col(n).alias("n")) for n, _ in parts])).alias("r")).select("r.*")


# ---- cohorts, catalogue


@query("cohort_projection_dropna", f"SELECT dataset, count(*) AS n, round(sum(discount), 4) + 0.0 AS discount FROM {ITEMS} WHERE dataset IN ('A', 'N') AND discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1")
def cohort_projection(s, d):
    rows = cohort.select_rows(items(s, d), InputData(datasets=("A", "N"), y=("discount",), x=("l_tax",)))
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), (F.round(F.sum("discount"), 4) + 0.0).alias("discount"))


@query("cohort_min_rows_gate", f"WITH c AS (SELECT * FROM {ITEMS} WHERE l_quantity > 48), g AS (SELECT site FROM c GROUP BY 1 HAVING count(*) >= (SELECT count(*) / 3.5 FROM c)) SELECT site, count(*) AS n FROM c WHERE site IN (SELECT site FROM g) GROUP BY 1")
def cohort_gate(s, d):
    rows = cohort.select_rows(items(s, d), InputData(y=("l_quantity",), filters={"id": "l_quantity", "operator": "greater", "value": 48}))
    return cohort.gate_plan(rows, F.lit(rows.count() / 3.5)).groupBy("site").agg(F.count("*").alias("n"))


@query("union_missing_columns", "SELECT 'o' AS src, k, price, CAST(NULL AS DOUBLE) AS qty FROM (SELECT o_orderkey AS k, o_totalprice AS price FROM orders) UNION ALL SELECT 'l', l_orderkey, l_extendedprice, l_quantity FROM lineitem")
def union_missing(s, d):
    o = table(s, d, "orders").select(F.lit("o").alias("src"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    li = table(s, d, "lineitem").select(F.lit("l").alias("src"), F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    return o.unionByName(li, allowMissingColumns=True)


@query("dataset_catalog", "SELECT DISTINCT trim(o_orderpriority) AS dataset FROM orders WHERE length(trim(o_orderpriority)) > 0")
def dataset_catalog(s, d):
    return csv_models.datasets(orders(s, d))


@query("dataset_site_dedup", f"SELECT data_model, dataset, min(site) AS site FROM (SELECT 'm' AS data_model, l_linestatus AS dataset, site FROM {ITEMS} UNION ALL SELECT 'm', 'only-' || site, site FROM {ITEMS}) GROUP BY 1, 2 HAVING count(DISTINCT site) = 1")
def dataset_site_dedup(s, d):
    t = items(s, d)
    held = t.select(F.lit("m").alias("data_model"), F.col("l_linestatus").alias("dataset"), "site").union(t.select(F.lit("m"), F.concat(F.lit("only-"), "site"), "site"))
    return landscape.unique_datasets(held)


@query("enum_coercion", "SELECT CAST(l_linenumber AS BIGINT) AS code, count(*) AS n FROM lineitem GROUP BY 1")
def enum_coercion(s, d):
    t = table(s, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("code"))
    return cohort.coerce_enumerations(t, {"code": [1, 2, 3, 4, 5, 6, 7]}).groupBy("code").agg(F.count("*").alias("n"))


@query("dataset_enlarge", "SELECT n_nationkey, n_name FROM nation, range(3)")
def dataset_enlarge(s, d):
    return csv_models.enlarge(table(s, d, "nation").select("n_nationkey", "n_name"), 3)


@query("vector_sum_min_max", "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(sum(l_tax), 4) + 0.0 AS tax, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def vector_sum_min_max(s, d):
    v = F.col
    r = Round().sum("n", F.lit(1)).sum("s", v("l_quantity"), v("l_tax")).min("lo", v("l_extendedprice")).max("hi", v("l_extendedprice")).run(table(s, d, "lineitem"))
    return rows_of(s, [(int(r["n"][0]), int(r["s"][0]), round(float(r["s"][1]), 4) + 0.0, r["lo"][0], r["hi"][0])], "n long, quantity long, tax double, lo double, hi double")


# ---- descriptive statistics, histograms

_NUMERIC = """SELECT variable, dataset, count(v) AS num_dtps, count(*) - count(v) AS num_na, count(*) AS num_total, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v), 6) + 0.0 AS std, min(v) + 0.0 AS min,
round(quantile_cont(v, 0.25), 6) + 0.0 AS q1, round(quantile_cont(v, 0.5), 6) + 0.0 AS q2, round(quantile_cont(v, 0.75), 6) + 0.0 AS q3, max(v) + 0.0 AS max FROM
(SELECT 'discount' AS variable, dataset, discount AS v FROM {t} UNION ALL SELECT 'l_quantity', dataset, l_quantity FROM {t}) GROUP BY 1, 2"""


def _numeric(rows: DataFrame) -> DataFrame:
    out = descriptive.numeric_summary(rows, ["discount", "l_quantity"])
    return out.select("variable", "dataset", "num_dtps", "num_na", "num_total", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "std", "min", "q1", "q2", "q3", "max")])


@query("descriptive_numeric_variable", _NUMERIC.format(t=ITEMS))
def descriptive_variable(s, d):
    return _numeric(items(s, d))


@query("descriptive_numeric_model", _NUMERIC.format(t=f"(SELECT * FROM {ITEMS} WHERE discount IS NOT NULL AND l_quantity IS NOT NULL)"))
def descriptive_model(s, d):
    return _numeric(items(s, d).dropna(subset=["discount", "l_quantity"]))


@query("descriptive_all_datasets", f"SELECT 'discount' AS variable, count(discount) AS num_dtps, round(avg(discount), 6) AS mean, round(stddev_samp(discount), 6) AS std, min(discount) AS min, max(discount) AS max FROM {ITEMS} UNION ALL SELECT 'l_quantity', count(*), round(avg(l_quantity), 6), round(stddev_samp(l_quantity), 6), min(l_quantity), max(l_quantity) FROM lineitem")
def descriptive_all(s, d):
    out = descriptive.descriptive_stats(items(s, d), ["discount", "l_quantity"], [])["variable_based"]
    got = [(r["variable"], r["data"]) for r in out if r["dataset"] == "all datasets"]
    return rows_of(s, [(v, x["num_dtps"], r6(x["mean"]), r6(x["std"]), x["min"], x["max"]) for v, x in got], "variable string, num_dtps long, mean double, std double, min double, max double")


@query("descriptive_nominal", f"SELECT 'l_linestatus' AS variable, dataset, l_linestatus AS value, count(*) AS n FROM {ITEMS} GROUP BY 1, 2, 3 UNION ALL SELECT 'site', dataset, site, count(*) FROM {ITEMS} GROUP BY 1, 2, 3")
def descriptive_nominal(s, d):
    return descriptive.nominal_summary(items(s, d), ["l_linestatus", "site"])


def _histogram_rows(s, out: dict) -> DataFrame:
    return rows_of(s, [(h["grouping_var"], h["grouping_enum"], k, None if n is None else int(n)) for h in out["histogram"] for k, n in enumerate(h["counts"])], "g string, level string, bin long, n long")


_HIST = "SELECT CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR) AS level, b AS bin, CASE WHEN n >= {k} THEN n END AS n FROM (SELECT b, count(x) AS n FROM range({bins}) r(b) LEFT JOIN ({src}) ON bin = b GROUP BY b)"
_HIST_G = "SELECT 'l_linestatus' AS g, lev AS level, b AS bin, CASE WHEN n >= {k} THEN n END AS n FROM (SELECT lev, b, count(x) AS n FROM range({bins}) r(b), (VALUES ('F'), ('O')) v(lev) LEFT JOIN ({src}) ON bin = b AND l_linestatus = lev GROUP BY 1, 2)"
_BINS = "SELECT l_linestatus, 1 AS x, least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / {bins})) AS INT), {bins} - 1) AS bin FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"


@query("hist_numeric", _HIST.format(k=1, bins=20, src=_BINS.format(bins=20)))
def hist_numeric(s, d):
    return _histogram_rows(s, descriptive.multiple_histograms(table(s, d, "lineitem"), "l_extendedprice", min_rows=1))


@query("hist_numeric_grouped", _HIST.format(k=10, bins=12, src=_BINS.format(bins=12)) + " UNION ALL " + _HIST_G.format(k=10, bins=12, src=_BINS.format(bins=12)))
def hist_grouped(s, d):
    return _histogram_rows(s, descriptive.multiple_histograms(table(s, d, "lineitem"), "l_extendedprice", ["l_linestatus"], 12, min_rows=10))


@query("hist_categorical", "SELECT CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR) AS level, b AS bin, CASE WHEN count(x) >= 10 THEN count(x) END AS n FROM (VALUES (0, 'R'), (1, 'A'), (2, 'N'), (3, 'X')) v(b, lev) LEFT JOIN (SELECT l_returnflag, 1 AS x FROM lineitem) ON l_returnflag = lev GROUP BY b")
def hist_categorical(s, d):
    return _histogram_rows(s, descriptive.multiple_histograms(table(s, d, "lineitem"), "l_returnflag", None, categorical=True, enumerations={"l_returnflag": ["R", "A", "N", "X"]}))


@query("hist_masked", "SELECT CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR) AS level, b AS bin, CASE WHEN n >= m THEN n END AS n FROM (SELECT b, count(x) AS n, (SELECT CAST(count(*) AS BIGINT) // 7 FROM lineitem) AS m FROM range(7) r(b) LEFT JOIN (SELECT l_linenumber - 1 AS bin, 1 AS x FROM lineitem) ON bin = b GROUP BY b)")
def hist_masked(s, d):
    t = table(s, d, "lineitem")
    return _histogram_rows(s, descriptive.multiple_histograms(t, "l_linenumber", None, categorical=True, enumerations={"l_linenumber": list("1234567")}, min_rows=t.count() // 7))


# ---- correlation, components, tests


@query("pearson_matrix", "SELECT 'l_quantity' AS y, 'l_extendedprice' AS x, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) + 0.0 FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', round(corr(l_discount, l_extendedprice), 6) + 0.0 FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) + 0.0 FROM lineitem")
def pearson_matrix(s, d):
    ys, xs = ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"]
    out = correlation.pearson_correlation(table(s, d, "lineitem"), ys, xs)["correlations"]
    return rows_of(s, [(y, x, r6(v)) for y in ys for x, v in zip(xs, out[y], strict=True)], "y string, x string, r double")


_Z = 0.06270677794321385  # normal quantile at 0.525


@query("pearson_interval", f"WITH t AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT n, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 6) AS hi FROM t")
def pearson_interval(s, d):
    out = correlation.pearson_correlation(table(s, d, "lineitem"), ["l_quantity"], ["l_extendedprice"], 0.95)
    return rows_of(s, [(out["n_obs"], r6(out["ci_lo"]["l_quantity"][0]), r6(out["ci_hi"]["l_quantity"][0]))], "n long, lo double, hi double")


def _values(s, out: dict) -> DataFrame:
    return rows_of(s, [(k, out["n_obs"], r6(v)) for k, v in enumerate(out["eigenvalues"])], "k long, n long, value double")


@query("pca_2var", "WITH t AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*) AS n FROM lineitem) SELECT 0 AS k, n, round(1 + r, 6) AS value FROM t UNION ALL SELECT 1, n, round(1 - r, 6) FROM t")
def pca_2(s, d):
    return _values(s, correlation.pca(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


_CUBIC = """, q AS (SELECT n, (a * a + b * b + c * c) / 3 AS p2, a * b * c AS det FROM t), g AS (SELECT n, sqrt(p2) AS p, det / pow(sqrt(p2), 3) AS h FROM q)
SELECT k, n, round(1 + 2 * p * cos(acos(greatest(-1.0, least(1.0, h))) / 3 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 2 END * pi() / 3), 6) + 0.0 AS value FROM g, range(3) r(k)"""


@query("pca_3var", "WITH t AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem)" + _CUBIC)
def pca_3(s, d):
    return _values(s, correlation.pca(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("pca_transform_log", "WITH t AS (SELECT count(*) AS n, corr(ln(l_quantity), exp(l_tax)) AS a, corr(ln(l_quantity), l_extendedprice) AS b, corr(exp(l_tax), l_extendedprice) AS c FROM lineitem)" + _CUBIC)
def pca_log(s, d):
    return _values(s, correlation.pca_with_transformation(table(s, d, "lineitem"), ["l_quantity", "l_tax", "l_extendedprice"], {"log": ["l_quantity"], "exp": ["l_tax"], "standardize": ["l_extendedprice"], "center": ["l_quantity"]}))


_T = "df long, t double, mean_diff double, se double, d double"


def _t(s, out: dict) -> DataFrame:
    return rows_of(s, [(out["df"], r6(out["t_stat"]), r6(out["mean_diff"]), r6(out["se_diff"]), r6(out["cohens_d"]))], _T)


@query("ttest_onesample", "WITH t AS (SELECT count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem) SELECT n - 1 AS df, round((m - 25) / (sd / sqrt(n)), 6) + 0.0 AS t, round(m, 6) AS mean_diff, round(sd / sqrt(n), 6) AS se, round(-(m - 25) / sd, 6) + 0.0 AS d FROM t")
def ttest_one(s, d):
    return _t(s, ttests.ttest_onesample(table(s, d, "lineitem"), "l_quantity", 25.0))


@query("ttest_paired", "WITH t AS (SELECT count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS sd, var_samp(l_discount) AS va, var_samp(l_tax) AS vb FROM lineitem) SELECT n - 1 AS df, round(m / (sd / sqrt(n)), 6) + 0.0 AS t, round(m, 6) AS mean_diff, round(sd / sqrt(n), 6) AS se, round(m / sqrt((va + vb) / 2), 6) + 0.0 AS d FROM t")
def ttest_pair(s, d):
    return _t(s, ttests.ttest_paired(table(s, d, "lineitem"), "l_discount", "l_tax"))


@query("ttest_independent", "WITH t AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag = 'N') AS nb, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS mb, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'N') AS vb FROM lineitem) SELECT na + nb - 2 AS df, round((ma - mb) / sqrt(va / na + vb / nb), 6) + 0.0 AS t, round(ma - mb, 6) + 0.0 AS mean_diff, round(sqrt(va / na + vb / nb), 6) AS se, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) + 0.0 AS d FROM t")
def ttest_ind(s, d):
    return _t(s, ttests.ttest_independent(table(s, d, "lineitem"), "l_quantity", "l_returnflag", "A", "N"))


# ---- analysis of variance

_CELLS = "SELECT l_returnflag AS g, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1"
_ONEWAY = f"WITH c AS ({_CELLS}), t AS (SELECT sum(n) AS n, sum(s) / sum(n) AS m, sum(q) - sum(s * s / n) AS r, count(*) AS k FROM c), e AS (SELECT sum(c.n * pow(c.s / c.n - t.m, 2)) AS e FROM c, t)"


@query("anova_oneway_table", f"{_ONEWAY} SELECT CAST(t.k - 1 AS BIGINT) AS df_e, CAST(t.n - t.k AS BIGINT) AS df_r, round(e, 4) + 0.0 AS ss_e, round(t.r, 2) AS ss_r, round((e / (t.k - 1)) / (t.r / (t.n - t.k)), 6) AS f FROM t, e")
def anova_one_table(s, d):
    a = anova.anova_oneway(table(s, d, "lineitem"), "l_quantity", "l_returnflag")["anova_table"]
    return rows_of(s, [(a["df_explained"], a["df_residual"], round(float(a["ss_explained"]), 4) + 0.0, round(float(a["ss_residual"]), 2), r6(a["f_stat"]))], "df_e long, df_r long, ss_e double, ss_r double, f double")


@query("anova_oneway_groups", f"{_ONEWAY} SELECT g, lo, hi, round(s / c.n, 6) AS mean, round(sqrt((c.n - 1) / CAST(c.n AS DOUBLE) * (q / c.n - pow(s / c.n, 2))), 6) AS sd FROM c")
def anova_one_groups(s, d):
    a = anova.anova_oneway(table(s, d, "lineitem"), "l_quantity", "l_returnflag")
    m = a["min_max_per_group"]
    return rows_of(s, [(g, lo, hi, r6(a["ci_info"]["means"][g]), r6(a["ci_info"]["sample_stds"][g])) for g, lo, hi in zip(m["categories"], m["min"], m["max"], strict=True)], "g string, lo double, hi double, mean double, sd double")


@query("tukey_pairs_stats", f"{_ONEWAY} SELECT a.g AS a, b.g AS b, round(a.s / a.n - b.s / b.n, 6) + 0.0 AS diff, round(sqrt(t.r / (t.n - t.k) * (1.0 / a.n + 1.0 / b.n)), 6) AS se, round((a.s / a.n - b.s / b.n) / sqrt(t.r / (t.n - t.k) * (1.0 / a.n + 1.0 / b.n)), 6) + 0.0 AS t FROM c a, c b, t WHERE a.g < b.g")
def tukey_pairs(s, d):
    out = anova.anova_oneway(table(s, d, "lineitem"), "l_quantity", "l_returnflag")["tuckey_test"]
    return rows_of(s, [(p["groupA"], p["groupB"], r6(p["diff"]), r6(p["se"]), r6(p["t_stat"])) for p in out], "a string, b string, diff double, se double, t double")


# the second factor has two levels: the fit of both factors is that of its indicator within the first one's groups
_TWO = """WITH d AS (SELECT l_returnflag AS g, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS q, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT g, avg(q) AS mq, avg(y) AS my FROM d GROUP BY g),
w AS (SELECT sum((q-mq)*(q-mq)) AS qq, sum((q-mq)*(y-my)) AS qy, sum((y-my)*(y-my)) AS ra FROM d JOIN c ON d.g = c.g),
t AS (SELECT count(*) AS n, sum((y-m)*(y-m)) AS r0 FROM d, (SELECT avg(y) AS m FROM d)),
b AS (SELECT sum(v) AS rb FROM (SELECT sum(y*y) - sum(y)*sum(y)/count(*) AS v FROM d GROUP BY q)),
full_ AS (SELECT sum(v) AS rfull, count(*) AS cells, count(DISTINCT g) AS gs FROM (SELECT g, sum(y*y) - sum(y)*sum(y)/count(*) AS v FROM d GROUP BY g, q)),
f AS (SELECT n, r0, ra, rb, ra - qy*qy/qq AS rab, rfull, cells, gs FROM w, t, b, full_)"""
_TWO_OUT = " SELECT 'l_returnflag' AS term, gs - 1 AS df, round({a}, 3) + 0.0 AS ss FROM f UNION ALL SELECT 'l_linestatus', 1, round({b}, 3) + 0.0 FROM f UNION ALL SELECT 'l_returnflag:l_linestatus', gs - 1, round(rab - rfull, 3) + 0.0 FROM f UNION ALL SELECT 'Residuals', n - cells, round(rfull, 1) FROM f"


def _two(s, d, kind: int) -> DataFrame:
    t = table(s, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    a = anova.anova_twoway(t, "y", "l_returnflag", "l_linestatus", kind)
    return rows_of(s, [(term, int(df), round(float(v), 1 if term == "Residuals" else 3) + 0.0) for term, df, v in zip(a["terms"], a["df"], a["sum_sq"], strict=True)], "term string, df long, ss double")


query("anova_twoway_type1", _TWO + _TWO_OUT.format(a="r0 - ra", b="ra - rab"))(lambda s, d: _two(s, d, 1))
query("anova_twoway_type2", _TWO + _TWO_OUT.format(a="rb - rab", b="ra - rab"))(lambda s, d: _two(s, d, 2))


# ---- linear regression


@query("linreg_simple", "SELECT count(*) AS n, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) + 0.0 AS b0, round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS b1, round(regr_r2(l_extendedprice / 1000, l_quantity), 6) AS r2, round(sqrt((regr_syy(l_extendedprice / 1000, l_quantity) - pow(regr_sxy(l_extendedprice / 1000, l_quantity), 2) / regr_sxx(l_extendedprice / 1000, l_quantity)) / (count(*) - 2)), 6) AS rse FROM lineitem")
def linreg_simple(s, d):
    t = table(s, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    out = regression.linear_regression(t, "y", ["l_quantity"])
    return rows_of(s, [(out["n_obs"], *[r6(b) for b in out["coefficients"]], r6(out["r_squared"]), r6(out["rse"]))], "n long, b0 double, b1 double, r2 double, rse double")


_DUMMY = """WITH d AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM d GROUP BY g),
w AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM d JOIN m USING (g)), a AS (SELECT g, my - b * mx AS v FROM m, w)"""


@query("linreg_dummies", f"{_DUMMY} SELECT 'Intercept' AS label, round(v, 6) + 0.0 AS coefficient FROM a WHERE g = 'A' UNION ALL SELECT 'l_returnflag[' || g || ']', round(v - (SELECT v FROM a WHERE g = 'A'), 6) + 0.0 FROM a WHERE g <> 'A' UNION ALL SELECT 'l_quantity', round(b, 6) FROM w")
def linreg_dummies(s, d):
    t = table(s, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    out = regression.linear_regression(t, "y", ["l_quantity", "l_returnflag"])
    return rows_of(s, [(k, r6(b)) for k, b in zip(out["indep_vars"], out["coefficients"], strict=True)], "label string, coefficient double")


def _fold_sql(src: str, k: int, order: str) -> str:
    """Rows with fold, by the formula for the place within the site."""
    return f"(SELECT *, CASE WHEN i < (n % {k}) * (n // {k} + 1) THEN i // (n // {k} + 1) ELSE n % {k} + (i - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY site) AS n FROM {src}))"


@query("kfold_ids", f"SELECT o_orderkey, CAST(fold AS INT) AS fold FROM {_fold_sql(ORDERS, 5, 'o_orderkey')}")
def kfold_ids(s, d):
    return folds.with_fold(orders(s, d).select("o_orderkey", "site"), 5, "o_orderkey").select("o_orderkey", "fold")


_CV = f"""WITH d AS (SELECT fold, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS x, o_totalprice / 1000 AS y FROM {_fold_sql(ORDERS, 4, 'o_orderkey')}),
b AS (SELECT k, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, count(*) AS n FROM d, range(4) r(k) WHERE fold <> k GROUP BY k),
e AS (SELECT fold, any_value(b.n) AS n, sqrt(avg(pow(y - b0 - b1 * x, 2))) AS rmse, avg(abs(y - b0 - b1 * x)) AS mae, 1 - sum(pow(y - b0 - b1 * x, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM d JOIN b ON fold = k GROUP BY fold)
SELECT CAST(sum(n) AS BIGINT) AS n, round(avg(rmse), 6) AS rmse, round(stddev_samp(rmse), 6) AS rmse_sd, round(avg(mae), 6) AS mae, round(avg(r2), 6) + 0.0 AS r2 FROM e"""


@query("linreg_cv", _CV)
def linreg_cv(s, d):
    t = orders(s, d).withColumns({"y": F.col("o_totalprice") / 1000, "x": F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)})
    out = regression.linear_regression_cv(t, "y", ["x"], 4, "o_orderkey")
    return rows_of(s, [(sum(out["n_obs"]), r6(out["mean_sq_error"]["mean"]), r6(out["mean_sq_error"]["std"]), r6(out["mean_abs_error"]["mean"]), r6(out["r_squared"]["mean"]))], "n long, rmse double, rmse_sd double, mae double, r2 double")


# ---- logistic regression: one common table expression an iteration

_STEPS = 8


def _newton_sql(src: str, by: str = "0") -> str:
    """Newton chain of the two-parameter model of t on x in ``src``, one model for each value of ``by``."""
    out = [f"d AS ({src})", "b0 AS (SELECT k, 0.0 AS b0, 0.0 AS b1 FROM (SELECT DISTINCT k FROM d))"]
    for i in range(_STEPS):
        out.append(f"""h{i} AS (SELECT d.k, any_value(b0) AS b0, any_value(b1) AS b1, sum(t - m) AS g0, sum(x * (t - m)) AS g1, sum(m * (1 - m)) AS h00, sum(x * m * (1 - m)) AS h01, sum(x * x * m * (1 - m)) AS h11
            FROM (SELECT d.k, x, t, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM d JOIN b{i} ON d.k = b{i}.k) d GROUP BY d.k)""")
        out.append(f"b{i + 1} AS (SELECT k, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM h{i})")
    return "WITH " + ",\n".join(out)


@query("logreg_newton", _newton_sql("SELECT 0 AS k, l_quantity / 50 AS x, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t FROM lineitem") + f" SELECT round(b0, 6) + 0.0 AS b0, round(b1, 6) + 0.0 AS b1, (SELECT count(*) FROM d) AS n FROM b{_STEPS}")
def logreg_newton(s, d):
    t = table(s, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("x"))
    out = regression.logistic_regression(t, "l_returnflag", ["x"], "R")["summary"]
    return rows_of(s, [(*[r6(b) for b in out["coefficients"]], out["n_obs"])], "b0 double, b1 double, n long")


_LOGCV_ROWS = _fold_sql(f"(SELECT *, o_totalprice / 100000 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS t FROM {ORDERS})", 3, "o_orderkey")
_LOGCV = _newton_sql(f"SELECT k, x, t FROM {_LOGCV_ROWS}, range(3) r(k) WHERE fold <> k") + f", p AS (SELECT fold, t, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM {_LOGCV_ROWS} JOIN b{_STEPS} ON fold = k)"


def _logcv(s, d) -> dict:
    t = orders(s, d).withColumn("x", F.col("o_totalprice") / 100000)
    return regression.logistic_regression_cv(t, "o_orderstatus", ["x"], "F", 3, "o_orderkey")


@query("logreg_cv_confusion", _LOGCV + " SELECT count_if(p >= 0.5 AND t = 1) AS tp, count_if(p >= 0.5 AND t = 0) AS fp, count_if(p < 0.5 AND t = 0) AS tn, count_if(p < 0.5 AND t = 1) AS fn FROM p")
def logreg_cv(s, d):
    m = _logcv(s, d)["confusion_matrix"]
    return rows_of(s, [(m["tp"], m["fp"], m["tn"], m["fn"])], "tp long, fp long, tn long, fn long")


@query("logreg_cv_roc", _LOGCV + " SELECT 'fold_' || CAST(fold + 1 AS INT) AS name, k, round(count(*) FILTER (WHERE p >= k / 100.0 AND t = 1) / count(*) FILTER (WHERE t = 1), 6) AS tpr, round(count(*) FILTER (WHERE p >= k / 100.0 AND t = 0) / count(*) FILTER (WHERE t = 0), 6) AS fpr FROM p, range(101) r(k) GROUP BY fold, k")
def logreg_roc(s, d):
    return rows_of(s, [(c["name"], k, r6(a), r6(b)) for c in _logcv(s, d)["roc_curves"] for k, (a, b) in enumerate(zip(c["tpr"], c["fpr"], strict=True))], "name string, k long, tpr double, fpr double")


@query("roc_curve", "WITH c AS (SELECT l_quantity AS threshold, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n - p) OVER w AS BIGINT) AS fp, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(n - p) OVER w / sum(n - p) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)")
def roc_points(s, d):
    t = table(s, d, "lineitem").select("l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("t"))
    return roc.roc_curve(t, "l_quantity", "t").select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


# ---- k-means: one common table expression an iteration

_K, _ITERATIONS = 3, 5


def _kmeans_sql() -> str:
    u = np.random.RandomState(123).uniform(0, 1, (_K, 2))
    start = " UNION ALL ".join(f"SELECT {k} AS k, lx + (hx - lx) * {float(u[k, 0])!r} AS cx, ly + (hy - ly) * {float(u[k, 1])!r} AS cy FROM b" for k in range(_K))
    out = ["d AS (SELECT l_extendedprice / 2000 AS x, l_quantity AS y FROM lineitem)", "b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM d)", f"c0 AS ({start})"]
    for i in range(_ITERATIONS):
        out.append(f"a{i} AS (SELECT x, y, (SELECT arg_min(k, (x - cx) * (x - cx) + (y - cy) * (y - cy)) FROM c{i}) AS k FROM d)")
        out.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(avg(x), 0.0) AS cx, coalesce(avg(y), 0.0) AS cy FROM c{i} LEFT JOIN a{i} ON a{i}.k = c{i}.k GROUP BY c{i}.k)")
    return "WITH " + ",\n".join(out) + f" SELECT k, round(cx, 6) AS x, round(cy, 6) AS y FROM c{_ITERATIONS}"


@query("kmeans_lloyd", _kmeans_sql())
def kmeans_lloyd(s, d):
    t = table(s, d, "lineitem").select((F.col("l_extendedprice") / 2000).alias("a"), F.col("l_quantity").alias("b"))
    out = kmeans.kmeans(t, ["a", "b"], _K, 0.0, _ITERATIONS)
    return rows_of(s, [(k, r6(x), r6(y)) for k, (x, y) in enumerate(out["centers"])], "k long, x double, y double")


# ---- naive Bayes

_GFIT = "SELECT l_returnflag AS label, count(*) AS n, avg(l_quantity) AS m0, var_pop(l_quantity) AS v0, avg(l_extendedprice) AS m1, var_pop(l_extendedprice) AS v1 FROM {t} GROUP BY 1"
_GX = ["l_quantity", "l_extendedprice"]


@query("nb_gaussian_fit", f"SELECT label, n, round(m0, 6) AS m0, round(v0, 4) AS v0, round(m1, 4) AS m1, round(v1 / 1e6, 4) AS v1 FROM ({_GFIT.format(t='lineitem')})")
def nb_gaussian_fit(s, d):
    m = naive_bayes.fit_gaussian(table(s, d, "lineitem"), "l_returnflag", _GX)
    return rows_of(s, [(c, int(m.class_count[k]), r6(m.theta[k, 0]), round(float(m.var[k, 0]), 4), round(float(m.theta[k, 1]), 4), round(float(m.var[k, 1]) / 1e6, 4)) for k, c in enumerate(m.labels)], "label string, n long, m0 double, v0 double, m1 double, v1 double")


_GSCORE = "ln(n / sum_n) - 0.5 * ln(2 * pi() * v0) - pow(l_quantity - m0, 2) / (2 * v0) - 0.5 * ln(2 * pi() * v1) - pow(l_extendedprice - m1, 2) / (2 * v1)"


@query("nb_gaussian_predict", f"WITH f AS (SELECT *, sum(n) OVER () AS sum_n FROM ({_GFIT.format(t='lineitem')})), p AS (SELECT i, l_returnflag AS truth, arg_max(label, {_GSCORE}) AS pred FROM (SELECT *, row_number() OVER () AS i FROM lineitem), f GROUP BY 1, 2) SELECT truth, pred, count(*) AS n FROM p GROUP BY 1, 2")
def nb_gaussian_predict(s, d):
    t = table(s, d, "lineitem")
    m = naive_bayes.fit_gaussian(t, "l_returnflag", _GX)
    return t.groupBy(F.col("l_returnflag").alias("truth"), naive_bayes.predicted(m, _GX).alias("pred")).agg(F.count("*").alias("n"))


@query("nb_categorical_fit", "SELECT l_returnflag AS label, 'l_linestatus' AS v, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 UNION ALL SELECT l_returnflag, 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 1, 2, 3 UNION ALL SELECT l_returnflag, NULL, NULL, count(*) FROM lineitem GROUP BY 1")
def nb_categorical_fit(s, d):
    return naive_bayes.categorical_counts(table(s, d, "lineitem"), "l_returnflag", ["l_linestatus", "l_linenumber"])


_CFOLD = _fold_sql(ORDERS, 3, "o_orderkey")


@query("nb_categorical_cv_confusion", f"""WITH d AS (SELECT o_orderkey, fold, o_orderstatus AS t, o_orderpriority AS p FROM {_CFOLD}),
n AS (SELECT k, t, count(*) AS n FROM d, range(3) r(k) WHERE fold <> k GROUP BY 1, 2), c AS (SELECT k, t, p, count(*) AS c FROM d, range(3) r(k) WHERE fold <> k GROUP BY 1, 2, 3),
s AS (SELECT d.o_orderkey, d.t AS truth, n.t AS label, ln(n.n / (SELECT sum(n) FROM n x WHERE x.k = n.k)) + ln((coalesce(c.c, 0) + 1.0) / (n.n + 5)) AS score FROM d JOIN n ON d.fold = n.k LEFT JOIN c ON c.k = n.k AND c.t = n.t AND c.p = d.p),
w AS (SELECT o_orderkey, truth, arg_max(label, score) AS pred FROM s GROUP BY 1, 2)
SELECT a.label AS truth, b.label AS pred, count(w.pred) AS n FROM (VALUES ('F'), ('O'), ('P')) a(label), (VALUES ('F'), ('O'), ('P')) b(label) LEFT JOIN w ON w.truth = a.label AND w.pred = b.label GROUP BY 1, 2""")
def nb_categorical_cv(s, d):
    m = naive_bayes.naive_bayes_categorical_cv(orders(s, d), "o_orderstatus", ["o_orderpriority"], 3, "o_orderkey")["confusion_matrix"]
    return rows_of(s, [(a, b, int(m["data"][i][j])) for i, a in enumerate(m["labels"]) for j, b in enumerate(m["labels"])], "truth string, pred string, n long")


@query("nb_gaussian_cv_confusion", f"""WITH d AS (SELECT o_orderkey, fold, o_orderstatus AS t, o_totalprice / 1000 AS x FROM {_CFOLD}),
n AS (SELECT k, t, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM d, range(3) r(k) WHERE fold <> k GROUP BY 1, 2),
s AS (SELECT d.o_orderkey, d.t AS truth, n.t AS label, ln(n.n / (SELECT sum(n) FROM n z WHERE z.k = n.k)) - 0.5 * ln(2 * pi() * v) - pow(x - m, 2) / (2 * v) AS score FROM d JOIN n ON d.fold = n.k),
w AS (SELECT o_orderkey, truth, arg_max(label, score) AS pred FROM s GROUP BY 1, 2)
SELECT a.label AS truth, b.label AS pred, count(w.pred) AS n FROM (VALUES ('F'), ('O'), ('P')) a(label), (VALUES ('F'), ('O'), ('P')) b(label) LEFT JOIN w ON w.truth = a.label AND w.pred = b.label GROUP BY 1, 2""")
def nb_gaussian_cv(s, d):
    t = orders(s, d).withColumn("x", F.col("o_totalprice") / 1000)
    m = naive_bayes.naive_bayes_gaussian_cv(t, "o_orderstatus", ["x"], 3, "o_orderkey")["confusion_matrix"]
    return rows_of(s, [(a, b, int(m["data"][i][j])) for i, a in enumerate(m["labels"]) for j, b in enumerate(m["labels"])], "truth string, pred string, n long")


# ---- two visits

_VISITS = "(SELECT a.l_orderkey, a.l_quantity AS q, b.l_tax + 0.0 AS tax, b.l_extendedprice - a.l_extendedprice AS diff FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"


def _visits(s, d) -> DataFrame:
    return longitudinal.pair_visits(table(s, d, "lineitem"), 1, 2, {"l_quantity": "first", "l_tax": "second", "l_extendedprice": "diff"}, "l_orderkey", "l_linenumber", also=())


@query("longitudinal_first_second_diff", f"SELECT l_orderkey, q, tax, round(diff, 4) + 0.0 AS diff FROM {_VISITS}")
def longitudinal_rows(s, d):
    return _visits(s, d).select("l_orderkey", F.col("l_quantity").alias("q"), (F.col("l_tax") + 0.0).alias("tax"), (F.round("l_extendedprice_diff", 4) + 0.0).alias("diff"))


@query("longitudinal_linreg", f"SELECT count(*) AS n, round(regr_intercept(diff / 1000, q), 6) + 0.0 AS b0, round(regr_slope(diff / 1000, q), 6) + 0.0 AS b1 FROM {_VISITS}")
def longitudinal_linreg(s, d):
    out = regression.linear_regression(_visits(s, d).withColumn("y", F.col("l_extendedprice_diff") / 1000), "y", ["l_quantity"])
    return rows_of(s, [(out["n_obs"], *[r6(b) for b in out["coefficients"]])], "n long, b0 double, b1 double")


# ---- event windows

@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2")
def event_windows(s, d):
    out = streams.windowed_summary(table(s, d, "events"), "ts", "value", "event_type")
    return out.select("start", "event_type", "n", (F.round("mean", 6) + 0.0).alias("mean"), "lo", "hi")


# ---- averages and deviations


@query("compute_average", f"SELECT 'l_quantity' AS variable, round(avg(l_quantity), 6) + 0.0 AS average FROM lineitem UNION ALL SELECT 'discount', round(avg(discount), 6) + 0.0 FROM {ITEMS}")
def averages(s, d):
    name, mean = moments.compute_average(items(s, d), ["l_quantity", "discount"])["columns"]
    return rows_of(s, [(n, r6(m)) for n, m in zip(name["data"], mean["data"], strict=True)], "variable string, average double")


@query("standard_deviation", "SELECT 'l_extendedprice' AS variable, round(stddev_pop(l_extendedprice), 6) + 0.0 AS std_deviation FROM lineitem")
def deviation(s, d):
    name, sd = moments.standard_deviation(items(s, d), "l_extendedprice")["columns"]
    return rows_of(s, [(name["data"][0], r6(sd["data"][0]))], "variable string, std_deviation double")


# ---- learners fitted within sites


@query("svm_linear")
def svm_linear(s, d):
    t = items(s, d).where("l_linestatus in ('F', 'O')").withColumn("x", F.datediff("l_shipdate", F.lit("1995-06-17")).cast("double")).withColumn("site", F.when(F.col("l_linenumber") < 4, "s1").otherwise("s2"))
    out = federated.svm_linear(t, "l_linestatus", ["x", "l_quantity"])
    return rows_of(s, [(k, r6(w)) for k, w in zip(["x", "l_quantity"], out["weights"], strict=True)], "variable string, weight double")


def _fedavg_sql(rounds: int) -> str:
    """The penalised step of every site from the shared weights, and the row-weighted mean of the sites', a round."""
    out = [f"d AS (SELECT site, o_totalprice / 100000 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS t FROM {ORDERS})", "b0 AS (SELECT 0.0 AS b0, 0.0 AS b1)"]
    for i in range(rounds):
        out.append(f"m{i} AS (SELECT site, x, t, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM d, b{i})")
        out.append(f"s{i} AS (SELECT site, count(*) AS n, b0 + (sum(t - m) - b0) / (sum(m * (1 - m)) + 1) AS b0, b1 + (sum(x * (t - m)) - b1) / (sum(x * x * m * (1 - m)) + 1) AS b1 FROM m{i} GROUP BY site, b0, b1)")
        out.append(f"b{i + 1} AS (SELECT sum(n * b0) / sum(n) AS b0, sum(n * b1) / sum(n) AS b1 FROM s{i})")
    return "WITH " + ",\n".join(out) + f" SELECT round(any_value(b0), 6) + 0.0 AS b0, round(any_value(b1), 6) + 0.0 AS b1, round(avg(CASE WHEN (b0 + b1 * x >= 0) = (t = 1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM d, b{rounds}"


@query("fedavg_logistic", _fedavg_sql(5))
def fedavg(s, d):
    out = federated.fedavg_logistic(orders(s, d), [F.lit(1.0), F.col("o_totalprice") / 100000], F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return rows_of(s, [(*[r6(b) for b in out["coefficients"]], r6(out["accuracy"]))], "b0 double, b1 double, accuracy double")


@query("boosted_trees")
def boosted(s, d):
    t = orders(s, d).withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double"))
    out = federated.boosted_trees(t, ["day", "o_totalprice"], F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return rows_of(s, [(r6(out["AUC"]), r6(out["initial_auc"]), out["auc_ascending"])], "auc double, initial_auc double, auc_ascending string")
