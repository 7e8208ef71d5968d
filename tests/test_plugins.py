import io
import json

import pytest

from cohortstats import __main__ as cli
from cohortstats import errors
from cohortstats.engine import Engine
from cohortstats.operators.moments import ComputeAverage, StandardDeviation
from cohortstats.service import dispatch
from cohortstats.sources import csv_models
from cohortstats.sources.csv_models import CDE, DataModel
from cohortstats.specs import SPECS, TRANSFORMERS, check_spec, load_specs

PLUGIN = '''
from cohortstats.registry import Algorithm
from cohortstats.specs import Parameter, Spec, Variable


class Rows(Algorithm):
    spec = Spec("rows", Variable(numerical=True), None, {"times": Parameter(("int",), low=1)})
    drop_na_rows = False
    add_dataset_variable = True

    def run(self, call):
        return {"n": call.rows.count() * call.p["times"], "columns": sorted(call.rows.columns)}
'''


@pytest.fixture
def engine(spark):
    rows = [("ab"[i % 2], "s1" if i % 2 else "s2", float(i) if i % 4 else None, i % 40, "BL" if i < 40 else "FL") for i in range(80)]
    rows += [("c", "s1", 1.0, 1, "BL"), ("c", "s2", 1.0, 1, "FL"), (None, "s1", 1.0, 1, "BL")]
    cdes = [CDE("dataset", is_categorical=True, enumerations=dict.fromkeys("abc", "")), CDE("v", sql_type="real"), CDE("subjectid", sql_type="int"), CDE("visitid", is_categorical=True, enumerations={"BL": "", "FL": ""})]
    e = Engine(spark)
    e.register(DataModel("m", "1", {c.code: c for c in cdes}), spark.createDataFrame(rows, "dataset string, site string, v double, subjectid long, visitid string"))
    return e


def request(y=("v",), **more):
    return {"inputdata": {"data_model": "m:1", "datasets": ["a", "b"], "y": list(y)}, **more}


def test_plugged_in_algorithms(engine, tmp_path):
    (tmp_path / "rows.py").write_text(PLUGIN)
    (tmp_path / "_private.py").write_text("raise ValueError")
    assert engine.discover(str(tmp_path)) == ["rows"]
    assert engine.run("rows", request(parameters={"times": 2})) == {"n": 160, "columns": ["dataset", "site", "v"]}
    with pytest.raises(errors.BadUserInput):
        engine.run("rows", request(parameters={"times": 0}))
    with pytest.raises(ValueError):
        engine.discover(str(tmp_path))
    assert set(engine.algorithms()) == {*SPECS, "rows"}


def test_average_and_deviation(engine):
    for a in (ComputeAverage, StandardDeviation):
        engine.add_algorithm(a)
    have = [float(i) for i in range(80) if i % 4]
    mean = sum(have) / len(have)
    assert engine.run("compute_average", request())["columns"] == [{"name": "variable", "data": ["v"], "type": "STR"}, {"name": "average", "data": [mean], "type": "FLOAT"}]
    sd = (sum((x - mean) ** 2 for x in have) / len(have)) ** 0.5
    assert engine.run("standard_deviation", request())["columns"][1]["data"] == [pytest.approx(sd)]


def test_catalogue_endpoints(engine):
    assert dispatch(engine, "GET", "/datasets_locations") == (200, {"m:1": {"a": "s2", "b": "s1"}})
    engine.tables["m:1"] = engine.tables["m:1"].where("dataset = 'a'")
    assert dispatch(engine, "POST", "/wla") == (200, "")
    assert dispatch(engine, "GET", "/datasets")[1] == {"m:1": ["a"]}
    assert dispatch(engine, "POST", "/flower/result", {"accuracy": 1})[0] == 200 and engine.learner_result == {"accuracy": 1}
    assert dispatch(engine, "GET", "/flower/input") == (200, {})
    dto = {s["name"]: s for s in dispatch(engine, "GET", "/algorithms")[1]}
    assert dto["pearson_correlation"]["parameters"]["alpha"]["default"] == 0.95 and dto["pca"]["label"] == "Pca"
    assert [s["name"] for s in dto["anova"]["preprocessing"]] == list(TRANSFORMERS) and dto["pca"]["preprocessing"] == []


@pytest.mark.parametrize("change", [{"visit1": "XX"}, {"visit2": None}, {"strategies": {"v": "third"}}, {"strategies": {"w": "first"}}, {"more": 1}])
def test_bad_visits(engine, change):
    step = {"visit1": "BL", "visit2": "FL", "strategies": {"v": "first", "subjectid": "first"}}
    data = {**request()["inputdata"], "x": ["subjectid"]}
    with pytest.raises(errors.BadUserInput):
        engine.run("linear_regression", {"inputdata": data, "preprocessing": {"longitudinal_transformer": {**step, **change}}})


@pytest.mark.parametrize("given", [{"sqrt": ["v"]}, {"log": ["subjectid"]}, {"log": "w"}])
def test_bad_dicts(engine, given):
    with pytest.raises(errors.BadUserInput):
        engine.run("pca_with_transformation", request(parameters={"data_transformation": given}))


def spec(parameter=None, **y):
    side = {"label": "Y", "desc": "", "types": ["real"], "stattypes": ["numerical"], "notblank": True, "multiple": False, **y}
    p = {"label": "P", "desc": "", "types": ["text"], "notblank": True, "multiple": False, **(parameter or {})}
    return {"name": "s", "desc": "", "label": "S", "enabled": True, "inputdata": {"y": side}, "parameters": {"p": p}}


def test_specs_from_json(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(spec({"enums": {"type": "input_var_CDE_enums", "source": ["y"]}, "default": "q"})))
    got = load_specs([str(tmp_path)])["s"]
    assert got.y.numerical and not got.y.nominal and got.x is None and got.parameters["p"].default == "q" and got.label == "S"
    (tmp_path / "b.json").write_text(json.dumps(spec()))
    with pytest.raises(ValueError):
        load_specs([str(tmp_path)])


@pytest.mark.parametrize(
    ("parameter", "y"),
    [
        ({"enums": {"type": "input_var_CDE_enums", "source": ["x"]}}, {}),
        ({"enums": {"type": "input_var_CDE_enums", "source": ["y"]}}, {"multiple": True}),
        ({"enums": {"type": "input_var_CDE_enums", "source": ["y"]}, "multiple": True}, {}),
        ({"enums": {"type": "fixed_var_CDE_enums", "source": ["v", "w"]}}, {}),
        ({"enums": {"type": "input_var_names", "source": ["y"]}, "types": ["int"]}, {}),
        ({"types": ["dict", "text"]}, {}),
        ({"types": ["dict"], "enums": {"type": "list", "source": ["a"]}}, {}),
        ({"dict_keys_enums": {"type": "list", "source": ["a"]}}, {}),
        ({"types": ["complex"]}, {}),
    ],
)
def test_specs_that_cannot_hold(tmp_path, parameter, y):
    (tmp_path / "a.json").write_text(json.dumps(spec(parameter, **y)))
    with pytest.raises(ValueError):
        load_specs([str(tmp_path)])


def test_own_specs_hold():
    assert all(check_spec(s) is s for s in SPECS.values())


def test_enabled_catalogue(spark, engine):
    frames = csv_models.metadata_frames(spark, list(engine.models.values()), engine.tables)
    assert {tuple(r) for r in csv_models.enabled_datasets(frames).collect()} == {("m:1", d) for d in "abc"}
    off = {**frames, "data_models": frames["data_models"].selectExpr("* except (status)", "'DISABLED' AS status")}
    assert csv_models.enabled_datasets(off).count() == 0


def test_piped_request(spark, tmp_path, monkeypatch):
    meta = {"code": "m", "version": "1", "variables": [{"code": "dataset", "sql_type": "text", "isCategorical": True, "enumerations": [{"code": "a"}]}, {"code": "v", "sql_type": "real"}]}
    (tmp_path / "CDEsMetadata.json").write_text(json.dumps(meta))
    (tmp_path / "a.csv").write_text("dataset,v\n" + "".join(f"a,{i}\n" for i in range(30)))
    body = {"inputdata": {"data_model": "m:1", "datasets": ["a"], "y": ["w"], "filters": ""}, "parameters": {"alpha": 0.05, "mu": 1.0, "alt_hypothesis": "less"}}
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(body)))
    out = json.loads(cli.main(["-a", "ttest_onesample", "-y", "v", "-p", "mu=2.0", "-r", "-", "--data", f"file:{tmp_path}"]))
    assert out["n_obs"] == 30 and out["mean_diff"] == pytest.approx(14.5)
