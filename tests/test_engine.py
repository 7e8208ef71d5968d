import json

import pytest

from cohortstats import errors
from cohortstats.engine import Engine
from cohortstats.sources.csv_models import CDE, DataModel
from cohortstats.specs import SPECS


@pytest.fixture(scope="module")
def engine(spark):
    rows = []
    for i in range(240):
        rows.append(("ab"[i % 2], "s1" if i % 2 else "s2", i, i % 17 + 0.25 * (i % 5), float((i * 7) % 23), "lo" if (i * 7) % 23 + i % 5 < 13 else "hi", "xyz"[i % 3], "pq"[(i // 3) % 2], i % 120, "BL" if i < 120 else "FL1"))
    table = spark.createDataFrame(rows, "dataset string, site string, row_id long, v double, w double, c string, g string, h string, subjectid long, visitid string")
    cat = lambda n, *codes: CDE(n, is_categorical=True, enumerations={k: k for k in codes})
    cdes = [cat("dataset", "a", "b"), CDE("v", sql_type="real"), CDE("w", sql_type="real"), cat("c", "lo", "hi"), cat("g", "x", "y", "z"), cat("h", "p", "q"), CDE("subjectid", sql_type="int"), cat("visitid", "BL", "FL1")]
    e = Engine(spark)
    e.register(DataModel("m", "1", {c.code: c for c in cdes}), table, validation_datasets=["val"])
    return e


REQUESTS = {
    "anova": (["v"], ["g", "h"], {"sstype": 2}),
    "anova_oneway": (["v"], ["g"], {}),
    "descriptive_stats": (["v", "g"], ["w"], {}),
    "kmeans": (["w", "v"], None, {"k": 2, "maxiter": 5, "tol": 0.01}),
    "linear_regression": (["v"], ["w", "g"], {}),
    "linear_regression_cv": (["v"], ["w", "g"], {"n_splits": 3}),
    "logistic_regression": (["c"], ["v"], {"positive_class": "hi"}),
    "logistic_regression_cv": (["c"], ["v", "h"], {"positive_class": "hi", "n_splits": 2}),
    "multiple_histograms": (["v"], ["g"], {"bins": 5}),
    "naive_bayes_categorical_cv": (["c"], ["g", "h"], {"n_splits": 2}),
    "naive_bayes_gaussian_cv": (["c"], ["v", "w"], {"n_splits": 2}),
    "pca": (["v", "w"], None, {}),
    "pca_with_transformation": (["v", "w"], None, {"data_transformation": {"exp": ["v"]}}),
    "pearson_correlation": (["v"], ["w"], {"alpha": 0.95}),
    "svm_scikit": (["c"], ["v", "w"], {"gamma": 0.1, "C": 1.0}),
    "ttest_independent": (["v"], ["g"], {"alt_hypothesis": "two-sided", "alpha": 0.05, "groupA": "x", "groupB": "y"}),
    "ttest_onesample": (["v"], None, {"alt_hypothesis": "less", "alpha": 0.05, "mu": 3.0}),
    "ttest_paired": (["v"], ["w"], {"alt_hypothesis": "two-sided", "alpha": 0.05}),
    "logistic_regression_fedaverage_flower": (["c"], ["v"], {}),
    "xgboost": (["c"], ["v", "w"], {}),
}


def request(name, **more):
    y, x, p = REQUESTS[name]
    data = {"data_model": "m:1", "datasets": ["a", "b"], "y": y, "x": x, "filters": None}
    if SPECS[name].validation:
        data["validation_datasets"] = ["val"]
    return {"inputdata": {**data, **more}, "parameters": p}


@pytest.mark.parametrize("name", sorted(SPECS))
def test_every_algorithm_answers(engine, name):
    out = json.loads(engine.run_json(name, request(name)))
    assert out


def test_all_specs_are_tested():
    assert set(REQUESTS) == set(SPECS)


def test_longitudinal_request(engine):
    r = request("linear_regression")
    r["preprocessing"] = {"longitudinal_transformer": {"visit1": "BL", "visit2": "FL1", "strategies": {"v": "diff", "w": "first", "g": "second"}}}
    out = engine.run("linear_regression", r)
    assert out["n_obs"] == 120 and out["indep_vars"] == ["Intercept", "g[y]", "g[z]", "w"] and out["dependent_var"] == "v_diff"


@pytest.mark.parametrize(
    ("name", "change", "error"),
    [
        ("pca", {"data_model": "zz"}, errors.BadUserInput),
        ("pca", {"datasets": ["nope"]}, errors.BadUserInput),
        ("pca", {"y": []}, errors.BadUserInput),
        ("pca", {"y": ["missing"]}, errors.BadUserInput),
        ("pca", {"y": ["g"]}, errors.BadUserInput),
        ("pca", {"x": ["v"]}, errors.BadUserInput),
        ("anova_oneway", {"x": ["g", "h"]}, errors.BadUserInput),
        ("pca", {"validation_datasets": ["val"]}, errors.BadUserInput),
        ("xgboost", {"validation_datasets": []}, errors.BadUserInput),
        ("pca", {"filters": {"id": "v", "operator": "like", "value": 1}}, errors.FilterError),
        ("pca", {"filters": {"id": "v", "operator": "greater", "value": 1e9}}, errors.InsufficientDataError),
    ],
)
def test_bad_inputdata(engine, name, change, error):
    with pytest.raises(error):
        engine.run(name, request(name, **change))


@pytest.mark.parametrize(("name", "p"), [("kmeans", {"k": 0, "maxiter": 5, "tol": 0.1}), ("kmeans", {"k": 2.5, "maxiter": 5, "tol": 0.1}), ("kmeans", {"k": 2}), ("pca", {"zz": 1}), ("anova", {"sstype": 3}), ("logistic_regression", {"positive_class": "no"})])
def test_bad_parameters(engine, name, p):
    r = request(name)
    r["parameters"] = p
    with pytest.raises(errors.BadUserInput):
        engine.run(name, r)


def test_flags_and_codes(engine):
    r = request("pca")
    for flags, error in (({"smpc": True}, errors.SMPCUsageError), ({"smpc": "yes"}, errors.BadRequest), ({"dp": True}, errors.BadRequest)):
        with pytest.raises(error):
            engine.run("pca", {**r, "flags": flags})
    assert [errors.status_of(e) for e in (errors.FilterError(), errors.BadUserInput(), errors.InsufficientDataError(), ValueError())] == [400, 460, 461, 500]
    with pytest.raises(errors.BadRequest):
        engine.run("unknown", r)


def test_kmeans_columns_are_alphabetical(engine):
    a, b = engine.run("kmeans", request("kmeans", y=["w", "v"])), engine.run("kmeans", request("kmeans", y=["v", "w"]))
    assert a == b


def test_service(engine):
    from cohortstats.service import dispatch

    assert dispatch(engine, "GET", "/healthcheck") == (200, {"healthy": True})
    assert dispatch(engine, "GET", "/datasets")[1] == {"m:1": ["a", "b"]}
    assert {s["name"] for s in dispatch(engine, "GET", "/algorithms")[1]} == set(SPECS)
    assert "v" in dispatch(engine, "GET", "/cdes_metadata")[1]["m:1"]
    assert dispatch(engine, "POST", "/algorithms/pca", request("pca"))[0] == 200
    assert dispatch(engine, "POST", "/algorithms/pca", {**request("pca"), "zz": 1})[0] == 400
    assert dispatch(engine, "POST", "/algorithms/pca", request("pca", y=["g"]))[0] == 460
    assert dispatch(engine, "POST", "/algorithms/pca", request("pca", filters={"id": "v", "operator": "greater", "value": 1e9}))[0] == 461
    assert dispatch(engine, "POST", "/algorithms/pca", None)[0] == 400 and dispatch(engine, "GET", "/nothing")[0] == 404
