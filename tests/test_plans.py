import pytest
from pyspark.sql import functions as F

from cohortstats import errors
from cohortstats import queries as harness
from cohortstats.operators import anova, descriptive, federated, kmeans, naive_bayes, regression, ttests
from cohortstats.plans import cohort, filters, folds, landscape, longitudinal
from cohortstats.plans.cohort import InputData
from cohortstats.plans.rounds import Round, gram
from cohortstats.sources import audit, csv_models
from cohortstats.sources.csv_models import CDE, DataModel
from cohortstats.streaming.statistics import RunningRound


@pytest.fixture(scope="module")
def people(spark):
    rows = [("a", "s1", i, float(i % 7), "x" if i % 3 else "y", None if i % 10 == 0 else float(i)) for i in range(60)]
    rows += [("b", "s2", 100 + i, float(i % 5) + 1, "x" if i % 2 else "y", float(i)) for i in range(30)]
    rows += [("c", "s3", 200 + i, 1.0, "x", 2.0) for i in range(4)]
    return spark.createDataFrame(rows, "dataset string, site string, row_id long, v double, g string, w double")


def test_filter_tree_and_nulls(people):
    tree = {"condition": "OR", "rules": [{"id": "w", "operator": "less", "value": 5}, {"condition": "AND", "rules": [{"id": "g", "operator": "equal", "value": "y"}, {"id": "w", "operator": "not_between", "value": [0, 50]}]}]}
    got = people.where(filters.to_column(tree)).count()
    rows = people.collect()
    want = sum(1 for r in rows if r.w is not None and (r.w < 5 or (r.g == "y" and not 0 <= r.w <= 50)))
    assert got == want
    assert filters.to_column(None) is None and filters.to_column({"condition": "AND", "rules": []}) is None


@pytest.mark.parametrize("bad", [{"x": 1}, {"condition": "XOR", "rules": []}, {"id": "v", "operator": "like", "value": 1}, {"id": "q", "operator": "equal", "value": 1}, {"id": "n", "operator": "equal", "value": "3.5"}, [1]])
def test_filter_validation(bad):
    with pytest.raises(errors.FilterError):
        filters.validate(bad, {"v": "real", "n": "int", "g": "text"})


def test_filter_validation_accepts():
    filters.validate({"condition": "AND", "rules": [{"id": "n", "operator": "in", "value": [1, "2"]}, {"id": "g", "operator": "is_null", "value": None}]}, {"n": "int", "g": "text"})


def test_predicates_reach_the_scan(people, tmp_path):
    path = str(tmp_path / "t")
    people.write.partitionBy("dataset").parquet(path)
    rows = cohort.select_rows(people.sparkSession.read.parquet(path), InputData(datasets=("a",), y=("v",), filters={"id": "w", "operator": "greater", "value": 3}))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(w,3.0)" in plan and "PartitionFilters: [isnotnull(dataset" in plan and "g:string" not in plan


def test_gate_drops_small_sites_or_raises(people):
    assert {r[0] for r in cohort.gate(people, 10).select("site").distinct().collect()} == {"s1", "s2"}
    assert cohort.gate_plan(people, F.lit(10)).count() == 90
    with pytest.raises(errors.InsufficientDataError):
        cohort.gate(people, 1000)


def test_enum_coercion(spark):
    t = spark.createDataFrame([("0",), ("1",), (None,)], "c string")
    assert [r.c for r in cohort.coerce_enumerations(t, {"c": [0, 1]}).collect()] == [0, 1, None]
    assert dict(cohort.coerce_enumerations(spark.createDataFrame([("0.5",)], "c string"), {"c": [0, 1]}).dtypes)["c"] == "string"
    assert [r.c for r in cohort.coerce_enumerations(spark.createDataFrame([(1.0,), (2.5,)], "c double"), {"c": ["1", "2"]}).collect()] == ["1", "2.5"]


@pytest.mark.parametrize("k", [2, 3, 7])
def test_folds_by_formula_and_by_window(people, k):
    big = people.where("site <> 's3'") if k > 4 else people
    a = {r.row_id: r.fold for r in folds.with_fold(big, k, "row_id").collect()}
    b = {r.row_id: r.fold for r in folds.with_fold_window(big, k, "row_id").collect()}
    assert a == b
    site = sorted(i for i in a if i < 100)
    sizes = [sum(a[i] == f for i in site) for f in range(k)]
    assert sizes == [60 // k + (f < 60 % k) for f in range(k)] and [a[i] for i in site] == sorted(a[i] for i in site)


def test_too_few_rows_for_folds(people):
    with pytest.raises(errors.BadUserInput):
        folds.with_fold(people, 5, "row_id")


def test_round_and_wide_gram(people):
    r = Round().sum("s", F.col("v"), F.col("w")).min("m", F.col("v")).max("m2", F.col("v")).run(people)
    assert r["s"][0] == sum(x.v for x in people.collect()) and r["m"][0] == 0 and r["m2"][0] == 6
    rows = people.dropna()
    wide = [F.col("v") + k for k in range(33)]
    assert gram(rows, wide)[:5, :5] == pytest.approx(gram(rows, wide[:5]))


def test_partition_invariance(people):
    y = people.dropna()
    one, three = y.withColumn("site", F.lit("s")), y.repartition(3)
    for f in (lambda t: regression.linear_regression(t, "w", ["v", "g"])["coefficients"], lambda t: [p["t_stat"] for p in anova.anova_oneway(t, "v", "g")["tuckey_test"]], lambda t: kmeans.kmeans(t, ["v", "w"], 2)["centers"][0]):
        assert f(one) == pytest.approx(f(three), rel=1e-9)


def test_linear_edge_cases(spark):
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    out = regression.linear_regression(few, "y", ["x"])
    assert out["df_resid"] == 0 and out["r_squared"] == 0.0 and out["rse"] != out["rse"]


def test_reference_level_is_first_observed(people):
    assert regression.linear_regression(people.dropna(), "w", ["g"])["indep_vars"] == ["Intercept", "g[y]"]


def test_logistic_needs_both_classes(people):
    with pytest.raises(errors.BadUserInput):
        regression.logistic_regression(people, "g", ["v"], "z")


def test_ttest_conventions(people):
    out = ttests.ttest_onesample(people, "v", mu=1.0, alt_hypothesis="greater")
    assert out["ci_upper"] == "Infinity" and isinstance(out["ci_lower"], str)
    assert out["mean_diff"] == pytest.approx(people.agg(F.avg("v")).first()[0]) and out["cohens_d"] == pytest.approx(-(out["mean_diff"] - 1) / out["std"])
    ind = ttests.ttest_independent(people, "v", "g", "x", "y")
    assert ind["df"] == 92


def test_anova_with_unobserved_levels(people):
    out = anova.anova_twoway(people, "v", "g", "site", 2, ["x", "y", "z"], ["s1", "s2", "s3"])
    assert out["df"][0] == 1 and sum(out["df"]) == people.count() - 1 - 0
    with pytest.raises(errors.BadUserInput):
        anova.anova_oneway(people.where("g = 'x'"), "v", "g")


def test_descriptive_masks_and_merges(people):
    out = descriptive.descriptive_stats(people, ["v", "w"], ["g"], ["a", "b", "c", "gone"], min_rows=10)
    by = {(r["variable"], r["dataset"]): r["data"] for r in out["variable_based"]}
    assert by["v", "c"] is None and by["v", "gone"] is None and by["w", "a"]["num_na"] == 6
    everything = by["v", "all datasets"]
    assert everything["num_total"] == 90 and "q1" not in everything
    assert by["g", "all datasets"]["counts"] == {"x": 40 + 15, "y": 20 + 15}
    assert {r["variable"]: r["data"] for r in out["model_based"] if r["dataset"] == "a"}["v"]["num_total"] == 54


def test_histogram_of_one_value(spark):
    t = spark.createDataFrame([(3.0,)] * 12, "v double")
    h = descriptive.multiple_histograms(t, "v", bins=4)["histogram"][0]
    assert h["bins"] == [3.0, 3.25, 3.5, 3.75, 4.0] and h["counts"] == [12, None, None, None]


def test_kmeans_empty_cluster_is_origin(spark):
    t = spark.createDataFrame([(5.0, 5.0)] * 3, "a double, b double")
    assert sorted(kmeans.kmeans(t, ["b", "a"], 2)["centers"]) == [[0.0, 0.0], [5.0, 5.0]]


def test_naive_bayes_summary_counts_average_row():
    import numpy as np

    m = [naive_bayes.multiclass_metrics(np.array([[8, 2], [1, 9]])), naive_bayes.multiclass_metrics(np.array([[7, 3], [0, 10]]))]
    s = naive_bayes.multiclass_summary(m, ["p", "q"], [20, 20])
    v = [s["recall"]["p"][k] for k in ("fold0", "fold1", "average")]
    assert s["recall"]["p"]["stdev"] == pytest.approx(np.std(v, ddof=1)) and s["n_obs"] == {"fold0": 20, "fold1": 20}


def test_site_learners(spark):
    rows = [(s, float(i), "p" if i + k > 20 else "n") for k, s in enumerate(("s1", "s2")) for i in range(40)]
    t = spark.createDataFrame(rows, "site string, x double, y string")
    out = federated.svm_linear(t, "y", ["x"], iterations=30)
    at = -out["intercept"][0] / out["weights"][0]
    assert 17 < at < 23 and out["weights"][0] > 0
    target = F.when(F.col("y") == "p", 1.0).otherwise(0.0)
    assert federated.fedavg_logistic(t, [F.lit(1.0), F.col("x") - 20], target)["accuracy"] > 0.9
    trees = federated.boosted_trees(t, ["x"], target, rounds=2, depth=2)
    assert trees["AUC"] > 0.95 and trees["auc_ascending"] == "correct"
    with pytest.raises(errors.BadUserInput):
        federated.svm_linear(t.where("y = 'p'"), "y", ["x"])


def test_registered_svm_runs_all_steps(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(federated, "svm_linear", lambda *args, **kwargs: seen.update(kwargs) or {"weights": [0.0, 0.0]})
    harness.queries()["svm_linear"](spark, "/root/testdata/sf0.001").collect()
    assert "iterations" not in seen  # the operator's own number


def test_longitudinal(spark):
    t = spark.createDataFrame([("d", 1, "BL", 1.0, "a"), ("d", 1, "FL1", 4.0, "b"), ("d", 2, "BL", 2.0, "a")], "dataset string, subjectid long, visitid string, v double, g string")
    got = longitudinal.pair_visits(t, "BL", "FL1", {"v": "diff", "g": "second"}).collect()
    assert [(r.subjectid, r.v_diff, r.g) for r in got] == [(1, 3.0, "b")]
    with pytest.raises(errors.BadUserInput):
        longitudinal.check(["v"], {"v": "first", "w": "first"}, set())
    with pytest.raises(errors.BadUserInput):
        longitudinal.check(["g"], {"g": "diff"}, {"g"})


def test_landscape():
    cdes = {"dataset": CDE("dataset", enumerations={"d1": "D1"}), "v": CDE("v", sql_type="real")}
    other = {**cdes, "dataset": CDE("dataset", enumerations={"d2": "D2", "d1": "other"})}
    m1, m2, odd = DataModel("m", "1", cdes, tags=("t",)), DataModel("m", "1", other, tags=("u",), properties={"k": 1}), DataModel("n", "1", {"v": CDE("v")})
    sites = [landscape.Site("w1", landscape.LOCAL, {"m:1": m1, "n:1": odd}, {"m:1": {"d1": "", "d9": ""}}), landscape.Site("w2", landscape.GLOBAL, {"m:1": m2, "n:1": DataModel("n", "1", {"v": CDE("v", sql_type="int")})}, {"m:1": {"d2": "", "d9": ""}})]
    models = landscape.compatible_models(sites)
    assert set(models) == {"m:1"} and models["m:1"].cdes["dataset"].enumerations == {"d1": "D1", "d2": "D2"} and models["m:1"].tags == ("t", "u")
    assert landscape.locations(sites) == {"m:1": {"d1": "w1", "d2": "w2"}}
    assert landscape.by_role(sites, "m:1", landscape.LOCAL) == ["d1"] and landscape.sites_of(sites, "m:1", ["d2"]) == ["w2"]
    with pytest.raises(errors.BadUserInput):
        landscape.by_role(sites, "zz", landscape.LOCAL)


def test_csv_models(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "CDEsMetadata.json").write_text('{"code": "m", "version": "0.1", "label": "M", "variables": [{"code": "dataset", "sql_type": "text", "isCategorical": true, "enumerations": [{"code": "a", "label": "A"}]}], "groups": [{"variables": [{"code": "n", "sql_type": "int", "isCategorical": false, "minValue": 0}], "groups": [{"variables": [{"code": "r", "sql_type": "real"}]}]}]}')
    (folder / "a.csv").write_text("dataset,n\na,1\na,\n")
    (folder / "b.csv").write_text("dataset,r\n b ,2.5\n,1\n")
    (tmp_path / "none").mkdir()
    found = csv_models.find_models(spark, str(tmp_path))
    (path, csvs), = found.items()
    model, table = csv_models.load_model(spark, path, csvs)
    assert model.name == "m:0.1" and model.table == "m_0_1" and list(model.cdes) == ["dataset", "n", "r"]
    assert dict(table.dtypes)["n"] == "bigint" and table.count() == 4 and {r[0] for r in csv_models.datasets(table).collect()} == {"a", "b"}
    frames = csv_models.metadata_frames(spark, [model], {model.name: table})
    assert frames["variables"].count() == 3 and frames["datasets"].count() == 2
    (folder / "c.csv").write_text("dataset,n\na,1\n")
    with pytest.raises(ValueError, match="more than one CSV"):
        csv_models.load_model(spark, path, csv_models.find_models(spark, str(tmp_path))[path])
    assert csv_models.healthcheck(spark)


def test_audit_events(spark):
    lines = ["2024-01-02 03:04:05,678 - INFO - Worker with id 'w1' joined the federation.", "noise", "2024-01-02 03:04:06 Dataset 'd' of datamodel 'm:1' was added in worker 'w1'."]
    got = audit.events(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("at").collect()
    assert [(r.action, r.subject, r.other) for r in got] == [("worker_joined", "w1", None), ("dataset_added", "d", "m:1")]


def test_running_round_adds_batches_once(people):
    r = RunningRound({"v": F.col("v")})
    r.add(people.where("dataset = 'a'"), 0)
    r.add(people.where("dataset <> 'a'"), 1)
    r.add(people, 1)
    assert r.n == 94 and r.sums["v"] == sum(x.v for x in people.collect()) and (r.lows["v"], r.highs["v"]) == (0, 6)


def test_streaming_windows(spark, tmp_path):
    from cohortstats.streaming.statistics import windowed_summary

    rows = [("2024-01-01 00:10:00", "k", 1.0), ("2024-01-01 00:20:00", "k", 3.0), ("2024-01-01 05:00:00", "k", 9.0)]
    spark.createDataFrame(rows, "t string, k string, v double").selectExpr("timestamp(t) as t", "k", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = windowed_summary(source, "t", "v", "k").writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.n, r.mean) for r in spark.table("windows").collect()} == {(2, 2.0), (1, 9.0)}
