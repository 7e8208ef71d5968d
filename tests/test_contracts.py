"""Result fields of requests, wide designs, row order, and learners against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortstats.operators import federated, regression, roc
from cohortstats.plans import folds
from cohortstats.plans.rounds import summed
from cohortstats.sources import csv_models

from .test_engine import engine, request  # noqa: F401

TTEST = {"t_stat", "df", "p", "mean_diff", "se_diff", "ci_upper", "ci_lower", "cohens_d"}
FIELDS = {
    "ttest_onesample": TTEST | {"n_obs", "std"}, "ttest_paired": TTEST, "ttest_independent": TTEST,
    "svm_scikit": {"title", "n_obs", "coeff", "support_vectors"}, "xgboost": {"AUC", "initial_auc", "auc_ascending"}, "logistic_regression_fedaverage_flower": {"accuracy"},
    "logistic_regression": {"dependent_var", "indep_vars", "summary"}, "logistic_regression_cv": {"dependent_var", "indep_vars", "summary", "confusion_matrix", "roc_curves"},
    "linear_regression_cv": {"dependent_var", "indep_vars", "n_obs", "mean_sq_error", "r_squared", "mean_abs_error", "f_stat"},
    "anova_oneway": {"anova_table", "tuckey_test", "min_max_per_group", "ci_info"},
}


@pytest.mark.parametrize("name", sorted(FIELDS))
def test_result_fields(engine, name):  # noqa: F811
    assert set(engine.run(name, request(name))) == FIELDS[name]


def hinge(x, y, w, b, c):
    return (w @ w) / 2 + c * np.maximum(1 - y * (x @ w + b), 0).sum()


def test_svm_reaches_the_least_objective(spark):
    r = np.random.RandomState(3)
    x = r.randn(300, 2) * [1, 5]
    y = np.where(x @ [1.0, -0.4] + 0.7 * r.randn(300) > 0.3, 1, -1)
    t = spark.createDataFrame([(float(a), float(b), "p" if s > 0 else "n") for (a, b), s in zip(x, y)], "a double, b double, y string").repartition(3)
    out = federated.svm_linear(t, "y", ["a", "b"])
    got = hinge(x, y, np.array(out["coeff"]), out["intercept"][0], 1.0)
    best, point, step = got, np.array([*out["coeff"], *out["intercept"]]), 0.2
    for k in range(20_000):
        new = point + step * 0.9997**k * r.randn(3)
        value = hinge(x, y, new[:2], new[2], 1.0)
        if value < best:
            best, point = value, new
    assert got <= best * 1.003
    near = y * (x @ np.array(out["coeff"]) + out["intercept"][0]) <= 1 + 1e-3
    assert out["support_vectors"] == pytest.approx(x[near].mean(0).tolist(), rel=1e-6)


def test_svm_of_three_classes(spark):
    rows = [("s", float(i % 30), "abc"[i % 30 // 10]) for i in range(90)]
    out = federated.svm_linear(spark.createDataFrame(rows, "site string, x double, y string"), "y", ["x"])
    assert out["classes"] == ["a", "b", "c"] and out["n_obs"] == 90 and out["coeff"][0] < 0 and len(out["support_vectors"]) == 1


def test_deep_trees(spark):
    r = np.random.RandomState(1)
    x = r.rand(600, 3)
    y = ((x[:, 0] * 4).astype(int) % 2 ^ (x[:, 1] > 0.5)).astype(float)
    t = spark.createDataFrame([("ab"[i % 2], *map(float, v), float(k)) for i, (v, k) in enumerate(zip(x, y))], "site string, x0 double, x1 double, x2 double, y double").repartition(4)
    out = federated.boosted_trees(t, ["x0", "x1", "x2"], F.col("y"))
    again = federated.boosted_trees(t.repartition(2), ["x0", "x1", "x2"], F.col("y"))
    assert out["AUC"] > 0.97 and out["AUC"] == pytest.approx(again["AUC"], abs=1e-6)


def wide(spark, columns=34, rows=500):
    r = np.random.RandomState(4)
    x = r.randn(rows, columns)
    y = x[:, 0] - 0.5 * x[:, 1] + r.randn(rows)
    t = spark.createDataFrame([(i, *map(float, v), float(k), "p" if k > 0 else "n") for i, (v, k) in enumerate(zip(x, y))], "row_id long, " + ", ".join(f"x{k} double" for k in range(columns)) + ", y double, c string")
    return t.repartition(3), x, y, [f"x{k}" for k in range(columns)]


def test_wide_regressions(spark):
    t, x, y, names = wide(spark)
    design = np.column_stack((np.ones(len(x)), x))
    got = regression.logistic_regression(t, "c", names, "p")["summary"]
    target, beta = (y > 0).astype(float), np.zeros(35)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta = beta + np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]), design.T @ (target - mu))
    assert got["coefficients"] == pytest.approx(beta.tolist(), abs=1e-4)
    cv = regression.logistic_regression_cv(t, "c", names, "p", 3, "row_id")
    assert cv["summary"]["accuracy"][3] > 0.6 and sum(cv["confusion_matrix"].values()) == 500
    few = regression.linear_regression_cv(t, "y", names[:5], 4, "row_id")
    monkey = regression.WIDE
    try:
        regression.WIDE = 3
        assert regression.linear_regression_cv(t, "y", names[:5], 4, "row_id")["r_squared"] == pytest.approx(few["r_squared"], abs=1e-9)
    finally:
        regression.WIDE = monkey
    assert regression.linear_regression_cv(t, "y", names, 4, "row_id")["indep_vars"][-1] == "x33"


def test_sums_by_key(spark):
    t = spark.createDataFrame([(1.0, [0, 1]), (2.0, [1]), (5.0, [])], "v double, k array<int>").repartition(2)
    assert {k: v.tolist() for k, v in summed(t, [F.col("v")], F.col("k"), lambda k, x: x.sum(0) * (k + 1)).items()} == {0: [1.0], 1: [6.0]}


def test_roc_over_partitions(spark):
    r = np.random.RandomState(2)
    score, hit = r.randint(0, 60, 500) / 60, r.rand(500) < 0.4
    t = spark.createDataFrame([(float(a), int(b)) for a, b in zip(score, hit)], "s double, t int").repartition(5)
    got = {x.threshold: (x.tp, x.fp) for x in roc.roc_curve(t, "s", "t").collect()}
    assert got == {float(a): (int((hit & (score >= a)).sum()), int((~hit & (score >= a)).sum())) for a in np.unique(score)}
    assert roc.roc_curve(t.limit(0), "s", "t").count() == 0


def test_rows_keep_the_order_of_files(spark, tmp_path):
    meta = '{"code": "m", "version": "1", "variables": [{"code": "dataset", "sql_type": "text"}, {"code": "v", "sql_type": "int"}]}'
    (tmp_path / "CDEsMetadata.json").write_text(meta)
    for k, name in enumerate("ab"):
        (tmp_path / f"{name}.csv").write_text("dataset,v\n" + "".join(f"{name},{100 * k + i}\n" for i in range(30)))
    _, table = csv_models.load_model(spark, f"file:{tmp_path}")
    assert [r.v for r in table.orderBy("__ordinal").collect()] == [*range(30), *range(100, 130)]
    fold = {r.v: r.fold for r in folds.with_fold(table, 3, "__ordinal").collect()}
    assert [fold[v] for v in sorted(fold)] == [0] * 20 + [1] * 20 + [2] * 20
