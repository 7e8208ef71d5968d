"""What each algorithm takes, and the validation of requests against it."""

from __future__ import annotations

import json
import numbers
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import BadRequest, BadUserInput, SMPCUsageError
from .plans import filters
from .sources.csv_models import CDE


@dataclass(frozen=True)
class Variable:
    """Which variables a request may name as y or x."""

    numerical: bool = False
    nominal: bool = False
    multiple: bool = False
    required: bool = True
    types: tuple[str, ...] = ("real", "int", "text")
    enumslen: int | None = None
    label: str = ""
    desc: str = ""


@dataclass(frozen=True)
class Values:
    """Where the values that a parameter may take come from.

    ``list``: the sources themselves; ``input_var_CDE_enums``: the codes of the request's x or y;
    ``fixed_var_CDE_enums``: the codes of one named variable; ``input_var_names``: the names in x or y.
    """

    type: str
    source: tuple

    def of(self, data: dict[str, Any], cdes: dict[str, CDE]) -> list:
        if self.type == "list":
            return list(self.source)
        if self.type == "fixed_var_CDE_enums":
            if self.source[0] not in cdes:
                raise BadUserInput(f"The variable '{self.source[0]}' does not exist in the data model provided.")
            return list(cdes[self.source[0]].enumerations)
        names = [n for side in self.source for n in data.get(side) or ()]
        return names if self.type == "input_var_names" else [c for n in names if n in cdes for c in cdes[n].enumerations]


def _of_side(side: str) -> Values:
    return Values("input_var_CDE_enums", (side,))


@dataclass(frozen=True)
class Parameter:
    """``default`` is a hint to clients; it is never filled in."""

    kinds: tuple[str, ...]
    required: bool = True
    multiple: bool = False
    low: float | None = None
    high: float | None = None
    enums: Values | None = None
    keys: Values | None = None  # of a dict
    values: Values | None = None
    default: Any = None
    label: str = ""
    desc: str = ""


@dataclass(frozen=True)
class Spec:
    name: str
    y: Variable
    x: Variable | None = None
    parameters: dict[str, Parameter] = field(default_factory=dict)
    validation: bool = False
    longitudinal: bool = False
    gated: bool = True
    enabled: bool = True
    label: str = ""
    desc: str = ""


_N, _NS = Variable(numerical=True), Variable(numerical=True, multiple=True)
_R = Variable(numerical=True, types=("real",))
_C, _CS = Variable(nominal=True), Variable(nominal=True, multiple=True)
_ANY = Variable(numerical=True, nominal=True, multiple=True)
_MAYBE = Variable(numerical=True, nominal=True, multiple=True, required=False)
_ALTERNATIVES = Parameter(("text",), enums=Values("list", ("two-sided", "less", "greater")))
_UNIT = Parameter(("real",), low=0, high=1)
_SPLITS = Parameter(("int",), low=2, high=20)

SPECS = {
    s.name: s
    for s in (
        Spec("anova", _N, Variable(nominal=True, multiple=True), {"sstype": Parameter(("int",), enums=Values("list", (1, 2)))}, longitudinal=True),
        Spec("anova_oneway", _N, _C, longitudinal=True),
        Spec("descriptive_stats", _ANY, _MAYBE, gated=False),
        Spec("kmeans", Variable(numerical=True, multiple=True, types=("real",)), None, {"k": Parameter(("int",), low=1, high=100), "maxiter": Parameter(("int",), low=1, high=100), "tol": _UNIT}),
        Spec("linear_regression", _R, _ANY, longitudinal=True),
        Spec("linear_regression_cv", _R, _ANY, {"n_splits": _SPLITS}, longitudinal=True),
        Spec("logistic_regression", _C, _ANY, {"positive_class": Parameter(("text", "int"), enums=_of_side("y"))}, longitudinal=True),
        Spec("logistic_regression_cv", _C, _ANY, {"positive_class": Parameter(("text", "int"), enums=_of_side("y")), "n_splits": _SPLITS}, longitudinal=True),
        Spec("multiple_histograms", Variable(numerical=True, nominal=True), Variable(nominal=True, multiple=True, required=False), {"bins": Parameter(("int",), required=False, low=1, high=100)}),
        Spec("naive_bayes_categorical_cv", _C, _CS, {"n_splits": _SPLITS}, longitudinal=True),
        Spec("naive_bayes_gaussian_cv", _C, _NS, {"n_splits": _SPLITS}, longitudinal=True),
        Spec("pca", _NS),
        Spec("pca_with_transformation", _NS, None, {"data_transformation": Parameter(("dict",), required=False, keys=Values("list", ("log", "exp", "center", "standardize")), values=Values("input_var_names", ("y",)))}),
        Spec("pearson_correlation", _NS, Variable(numerical=True, multiple=True, required=False), {"alpha": Parameter(("real",), low=0, high=1, default=0.95)}),
        Spec("svm_scikit", _CS, _NS, {"gamma": _UNIT, "C": _UNIT}),
        Spec("ttest_independent", _N, Variable(nominal=True), {"alt_hypothesis": _ALTERNATIVES, "alpha": _UNIT, "groupA": Parameter(("text", "int"), enums=_of_side("x")), "groupB": Parameter(("text", "int"), enums=_of_side("x"))}),
        Spec("ttest_onesample", _N, None, {"alt_hypothesis": _ALTERNATIVES, "alpha": _UNIT, "mu": Parameter(("real",), low=-10, high=10)}),
        Spec("ttest_paired", _N, Variable(numerical=True), {"alt_hypothesis": _ALTERNATIVES, "alpha": _UNIT}),
        Spec("logistic_regression_fedaverage_flower", _C, _ANY, validation=True),
        Spec("xgboost", _C, _ANY, validation=True),
    )
}
VISIT = "visitid"
#: The step that a request may name under preprocessing, and its parameters.
TRANSFORMERS = {
    "longitudinal_transformer": {
        "visit1": Parameter(("text",), enums=Values("fixed_var_CDE_enums", (VISIT,))),
        "visit2": Parameter(("text",), enums=Values("fixed_var_CDE_enums", (VISIT,))),
        "strategies": Parameter(("dict",), keys=Values("input_var_names", ("x", "y")), values=Values("list", ("diff", "first", "second"))),
    }
}
_PYTHON = {"real": numbers.Real, "int": int, "text": str, "boolean": bool, "dict": dict}


def validate_request(algorithm: str, request: dict[str, Any], cdes: dict[str, CDE], datasets: list[str], validation_datasets: list[str] = (), smpc: bool = False, specs: dict[str, Spec] = SPECS) -> Spec:
    """Raises unless the request can run: known algorithm, data sets, variables, parameters, filter, flags."""
    if algorithm not in specs or not specs[algorithm].enabled:
        raise BadRequest(f"Algorithm '{algorithm}' does not exist.")
    spec, data = specs[algorithm], request.get("inputdata") or {}
    if missing := set(data.get("datasets") or ()) - set(datasets):
        raise BadUserInput(f"Datasets {sorted(missing)} could not be found for data_model '{data.get('data_model')}'.")
    asked = data.get("validation_datasets")
    if spec.validation and not asked:
        raise BadUserInput("Algorithm requires validation datasets.")
    if asked and not spec.validation:
        raise BadUserInput("Algorithm does not take validation datasets.")
    if asked and (missing := set(asked) - set(validation_datasets)):
        raise BadUserInput(f"Validation datasets {sorted(missing)} could not be found.")
    for side in ("y", "x"):
        _check_side(side, data.get(side), getattr(spec, side), cdes)
    _check_parameters(spec.parameters, request.get("parameters") or {}, data, cdes)
    filters.validate(data.get("filters"), {c: v.sql_type for c, v in cdes.items()})
    for flag, value in (request.get("flags") or {}).items():
        if flag != "smpc":
            raise BadRequest(f"Flag '{flag}' does not exist.")
        if not isinstance(value, bool):
            raise BadRequest("Flag 'smpc' should be a boolean.")
        if value and not smpc:
            raise SMPCUsageError("SMPC cannot be used, since it's not enabled.")
    pre = request.get("preprocessing") or {}
    if unknown := set(pre) - set(TRANSFORMERS):
        raise BadRequest(f"Preprocessing step {sorted(unknown)} does not exist.")
    if pre and not spec.longitudinal:
        raise BadRequest(f"Algorithm '{algorithm}' is not compatible with the longitudinal transformer.")
    for step, given in pre.items():
        _check_parameters(TRANSFORMERS[step], given or {}, data, cdes)
    return spec


def _check_side(side: str, names: list[str] | None, spec: Variable | None, cdes: dict[str, CDE]) -> None:
    if not names:
        if spec is not None and spec.required:
            raise BadUserInput(f"Inputdata '{side}' should be provided.")
        return
    if spec is None:
        raise BadUserInput(f"Inputdata '{side}' should not be provided.")
    if not isinstance(names, (list, tuple)):
        raise BadRequest(f"Inputdata '{side}' should be a list.")
    if len(names) > 1 and not spec.multiple:
        raise BadUserInput(f"Inputdata '{side}' cannot have multiple values.")
    for n in names:
        if n not in cdes:
            raise BadUserInput(f"The variable '{n}' does not exist in the data model provided.")
        kind = cdes[n].sql_type
        if kind not in spec.types and not (kind == "int" and "real" in spec.types):
            raise BadUserInput(f"The CDE '{n}' of inputdata '{side}' doesn't have one of the allowed types {list(spec.types)}.")
        if not (spec.nominal if cdes[n].is_categorical else spec.numerical):
            raise BadUserInput(f"The CDE '{n}' of inputdata '{side}' should be {'numerical' if cdes[n].is_categorical else 'nominal'}.")
        if spec.enumslen is not None and len(cdes[n].enumerations) != spec.enumslen:
            raise BadUserInput(f"The CDE '{n}' of inputdata '{side}' should have {spec.enumslen} enumerations.")


def _check_parameters(known: dict[str, Parameter], given: dict[str, Any], data: dict[str, Any], cdes: dict[str, CDE]) -> None:
    if unknown := set(given) - set(known):
        raise BadUserInput(f"Parameters {sorted(unknown)} do not exist in the algorithm.")
    for name, p in known.items():
        value = given.get(name)
        if value is None:
            if p.required:
                raise BadUserInput(f"Parameter '{name}' should not be blank.")
            continue
        if p.multiple and not isinstance(value, (list, tuple)):
            raise BadUserInput(f"Parameter '{name}' should be a list.")
        for v in value if p.multiple else [value]:
            if not any(isinstance(v, _PYTHON[k]) and not (isinstance(v, bool) and k != "boolean") for k in p.kinds):
                raise BadUserInput(f"Parameter '{name}' values should be of types {list(p.kinds)}.")
            if p.enums is not None:
                _check_value(f"Parameter '{name}' values", v, p.enums, data, cdes)
            if isinstance(v, dict):
                for key, held in v.items():
                    if p.keys is not None:
                        _check_value(f"Parameter '{name}' keys", key, p.keys, data, cdes)
                    for one in (held if isinstance(held, (list, tuple)) else [held]) if p.values is not None else ():
                        _check_value(f"Parameter '{name}' values", one, p.values, data, cdes)
            elif p.low is not None and v < p.low or p.high is not None and v > p.high:
                raise BadUserInput(f"Parameter '{name}' values should be within [{p.low}, {p.high}].")


def _check_value(what: str, value: Any, allowed: Values, data: dict[str, Any], cdes: dict[str, CDE]) -> None:
    codes = allowed.of(data, cdes)
    same = value in codes if allowed.type == "list" else str(value) in map(str, codes)
    if not same and (codes or allowed.type != "input_var_CDE_enums"):
        raise BadUserInput(f"{what} should be one of {codes}.")


def check_spec(spec: Spec) -> Spec:
    """The spec, if its parameters can be checked at all; ValueError otherwise."""
    for name, p in spec.parameters.items():

        def wrong(why: str, name: str = name) -> ValueError:
            return ValueError(f"Specification of '{spec.name}', parameter '{name}': {why}.")

        if unknown := set(p.kinds) - set(_PYTHON):
            raise wrong(f"no such types {sorted(unknown)}")
        if "dict" in p.kinds:
            if len(p.kinds) > 1:
                raise wrong("a dict can't be of other types, too")
            if p.enums is not None:
                raise wrong("a dict takes enumerations of keys and of values")
        elif p.keys is not None or p.values is not None:
            raise wrong("only a dict has keys and values")
        for v in (p.enums, p.keys, p.values):
            if v is not None and v.type not in ("list", "input_var_CDE_enums", "fixed_var_CDE_enums", "input_var_names"):
                raise wrong(f"no such enumeration '{v.type}'")
        if p.enums is None:
            continue
        if p.enums.type.endswith("_CDE_enums") and len(p.enums.source) != 1:
            raise wrong("the codes come from one variable")
        if p.enums.type == "input_var_CDE_enums":
            side = {"x": spec.x, "y": spec.y}.get(p.enums.source[0])
            if side is None:
                raise wrong("the codes come from x or y")
            if p.multiple or side.multiple:
                raise wrong("neither it nor its variable may be multiple")
        if p.enums.type == "input_var_names" and tuple(p.kinds) != ("text",):
            raise wrong("names are text")
    return spec


def spec_of(v: dict[str, Any]) -> Spec:
    """A spec from its JSON object."""

    def variable(d: dict[str, Any] | None) -> Variable | None:
        if d is None:
            return None
        kinds = d.get("stattypes") or ("numerical", "nominal")
        return Variable("numerical" in kinds, "nominal" in kinds, bool(d.get("multiple")), bool(d.get("notblank")), tuple(d["types"]), d.get("enumslen"), d.get("label", ""), d.get("desc", ""))

    def values(d: dict[str, Any] | None) -> Values | None:
        return None if d is None else Values(d["type"], tuple(d["source"]))

    parameters = {
        k: Parameter(tuple(d["types"]), bool(d.get("notblank")), bool(d.get("multiple")), d.get("min"), d.get("max"), values(d.get("enums")), values(d.get("dict_keys_enums")), values(d.get("dict_values_enums")), d.get("default"), d.get("label", ""), d.get("desc", ""))
        for k, d in (v.get("parameters") or {}).items()
    }
    given = v["inputdata"]
    return check_spec(Spec(v["name"], variable(given["y"]), variable(given.get("x")), parameters, bool(given.get("validation")), bool(v.get("longitudinal")), enabled=bool(v.get("enabled", True)), label=v.get("label", ""), desc=v.get("desc", "")))


def load_specs(folders: Iterable[str]) -> dict[str, Spec]:
    """The specs in the folders' JSON files by name; a name may occur once."""
    out: dict[str, Spec] = {}
    for path in sorted(p for folder in folders for p in Path(folder).glob("*.json")):
        spec = spec_of(json.loads(path.read_text()))
        if spec.name in out:
            raise ValueError(f"Algorithm '{spec.name}' is specified twice.")
        out[spec.name] = spec
    return out
