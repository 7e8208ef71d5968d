"""Requests in, JSON-ready results out.

    engine = Engine(spark)
    engine.register(model, table)                 # table: a DataFrame with dataset (and site)
    engine.run("linear_regression", {"inputdata": {...}, "parameters": {...}})
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadRequest, BadUserInput
from .operators import anova, correlation, descriptive, federated, kmeans, naive_bayes, regression, ttests
from .plans import cohort, landscape, longitudinal
from .plans.cohort import DATASET, SITE, InputData
from .plans.design import design, observed_levels
from .registry import Algorithm, algorithms_in, checked
from .sources.csv_models import CDE, DataModel
from .specs import SPECS, Spec, validate_request

#: Columns that give a table's rows a stable order for cross-validation, the first that is there.
ORDER_COLUMNS = ("__ordinal", "row_id", "subjectcode")


class Engine:
    def __init__(self, spark: SparkSession, min_rows: int = cohort.MIN_ROWS, smpc: bool = False):
        self.spark, self.min_rows, self.smpc = spark, min_rows, smpc
        self.models: dict[str, DataModel] = {}
        self.tables: dict[str, DataFrame] = {}
        self.validation: dict[str, list[str]] = {}
        self._datasets: dict[str, list[str]] = {}
        self._named: dict[str, list[str] | None] = {}
        self.plugins: dict[str, type[Algorithm]] = {}
        self.learner_input: dict[str, Any] = {}  # of the last request to learn within sites
        self.learner_result: Any = None

    def add_algorithm(self, algorithm: type[Algorithm]) -> None:
        self.plugins[algorithm.spec.name] = checked(algorithm, self.specs)

    def discover(self, *folders: str) -> list[str]:
        """Adds the algorithms of the folders' Python files; their names."""
        found = algorithms_in(folders)
        for algorithm in found:
            self.add_algorithm(algorithm)
        return [a.spec.name for a in found]

    @property
    def specs(self) -> dict[str, Spec]:
        return {**SPECS, **{n: a.spec for n, a in self.plugins.items()}}

    def register(self, model: DataModel, table: DataFrame, validation_datasets: list[str] | None = None, datasets: list[str] | None = None) -> None:
        """``datasets``: the names, where they are known; otherwise they are read from the table."""
        self.models[model.name], self.tables[model.name] = model, table
        self.validation[model.name] = list(validation_datasets or [])
        self._named[model.name] = datasets
        self._read_datasets(model.name)

    def _read_datasets(self, model: str) -> None:
        table, named = self.tables[model], self._named[model]
        found = named if named is not None else [r[0] for r in table.select(DATASET).distinct().collect()] if DATASET in table.columns else []
        self._datasets[model] = sorted(d for d in found if d and d not in self.validation[model])

    def refresh(self) -> None:
        """Reads the tables' data sets again."""
        for model in self.models:
            self._read_datasets(model)

    def locations(self, model: str) -> dict[str, str]:
        """The site of each data set; one that several sites hold is nowhere."""
        table = self.tables[model]
        if not {DATASET, SITE} <= set(table.columns):
            return {}
        rows = landscape.unique_datasets(table.where(f"{DATASET} is not null"), (DATASET,), SITE).collect()
        return {r[DATASET]: r[SITE] for r in sorted(rows)}

    def datasets(self, model: str) -> list[str]:
        return self._datasets[model]

    def algorithms(self) -> list[str]:
        return sorted(n for n, s in self.specs.items() if s.enabled)

    def cdes_metadata(self, model: str) -> dict[str, CDE]:
        return self.models[model].cdes

    def run_json(self, algorithm: str, request: dict[str, Any]) -> str:
        return json.dumps(self.run(algorithm, request), default=float)

    def run(self, algorithm: str, request: dict[str, Any]) -> dict[str, Any]:
        data = InputData.of(request.get("inputdata") or {})
        if data.data_model not in self.models:
            raise BadUserInput(f"Data model '{data.data_model}' does not exist.")
        model, table = self.models[data.data_model], self.tables[data.data_model]
        spec = validate_request(algorithm, request, model.cdes, self._datasets[model.name], self.validation[model.name], self.smpc, self.specs)
        plugin = self.plugins.get(algorithm)
        categorical = {c for c in data.variables if model.cdes[c].is_categorical}
        order = next((c for c in ORDER_COLUMNS if c in table.columns), None)
        if algorithm == "descriptive_stats":
            rows = cohort.select_rows(table, data, dropna=False)
            names = [v for v in data.variables if v != DATASET]
            return descriptive.descriptive_stats(rows, [v for v in names if v not in categorical], [v for v in names if v in categorical], list(data.datasets), self.min_rows)
        pre = (request.get("preprocessing") or {}).get("longitudinal_transformer")
        extra = ("subjectid", "visitid") if pre else ()
        rows = cohort.select_rows(table, data, dropna=plugin is None or plugin.drop_na_rows, extra=extra, keep=(DATASET, SITE, *((order,) if order else ())))
        enums = {c: list(model.cdes[c].enumerations) for c in categorical}
        rows = cohort.coerce_enumerations(rows, enums)
        if plugin is None or plugin.check_min_rows:
            rows = cohort.gate(rows, self.min_rows)
        y, x = list(data.y), list(data.x)
        if pre:
            strategies = pre["strategies"]
            longitudinal.check(data.variables, strategies, categorical)
            rows = longitudinal.pair_visits(rows, pre["visit1"], pre["visit2"], strategies, also=(DATASET, SITE))
            y, x = longitudinal.renamed(y, strategies), longitudinal.renamed(x, strategies)
            order = "subjectid"
        p = {k: v for k, v in (request.get("parameters") or {}).items() if v is not None}
        held_out = None
        if spec.validation and DATASET in rows.columns:  # validation data sets never train
            held_out = rows.where(F.col(DATASET).isin(*data.validation_datasets))
            rows = rows.where(F.col(DATASET).isin(*data.datasets))
            self.learner_input = request.get("inputdata") or {}
        if plugin is not None and not plugin.add_dataset_variable and DATASET not in data.variables:
            rows = rows.drop(DATASET)
        run = _RUN[spec.name] if plugin is None else plugin().run
        return run(_Call(rows, y, x, p, [v for v in x if v in categorical], y[0] in categorical, enums, order, self.min_rows, held_out))


class _Call:
    def __init__(self, rows, y, x, p, cats, y_nominal, enums, order, min_rows, held_out=None):
        self.rows, self.y, self.x, self.p, self.cats, self.y_nominal, self.enums, self.order, self.min_rows, self.held_out = rows, y, x, p, cats, y_nominal, enums, order, min_rows, held_out

    @property
    def ordered(self) -> str:
        if self.order is None:
            raise BadRequest(f"Cross validation needs a column that orders rows, one of {list(ORDER_COLUMNS)}.")
        return self.order

    def matrix(self):
        levels = observed_levels(self.rows, self.cats)
        labels, columns = design(levels, [v for v in self.x if v not in self.cats])
        target = F.when(F.col(f"`{self.y[0]}`").cast("string") == max(map(str, self.enums.get(self.y[0]) or [1])), 1.0).otherwise(0.0)
        return labels, columns, target


def _anova(c: _Call):
    if len(c.x) != 2:
        raise BadUserInput("Anova two-way only works with two variables.")
    return anova.anova_twoway(c.rows, c.y[0], *c.x, sstype=c.p.get("sstype", 2), levels1=c.enums.get(c.x[0]), levels2=c.enums.get(c.x[1]))


def _svm(c: _Call):
    out = federated.svm_linear(c.rows, c.y[0], c.x, **c.p)
    return {k: out[k] for k in ("title", "n_obs", "coeff", "support_vectors")}


def _trees(c: _Call):
    _, columns, target = c.matrix()
    rows = c.rows.select(*([SITE] if SITE in c.rows.columns else []), target.alias("__t"), *[col.alias(f"x{k}") for k, col in enumerate(columns[1:])])
    return federated.boosted_trees(rows, [f"x{k}" for k in range(len(columns) - 1)], F.col("__t"))


_RUN: dict[str, Callable[[_Call], dict[str, Any]]] = {
    "anova": _anova,
    "anova_oneway": lambda c: anova.anova_oneway(c.rows, c.y[0], c.x[0], c.enums.get(c.x[0])),
    "kmeans": lambda c: kmeans.kmeans(c.rows, c.y, **c.p),
    "linear_regression": lambda c: regression.linear_regression(c.rows, c.y[0], c.x, c.cats),
    "linear_regression_cv": lambda c: regression.linear_regression_cv(c.rows, c.y[0], c.x, c.p["n_splits"], c.ordered, c.cats),
    "logistic_regression": lambda c: regression.logistic_regression(c.rows, c.y[0], c.x, c.p["positive_class"], c.cats),
    "logistic_regression_cv": lambda c: regression.logistic_regression_cv(c.rows, c.y[0], c.x, c.p["positive_class"], c.p["n_splits"], c.ordered, c.cats),
    "multiple_histograms": lambda c: descriptive.multiple_histograms(c.rows, c.y[0], c.x, c.p.get("bins", 20), c.y_nominal, c.enums, c.min_rows),
    "naive_bayes_categorical_cv": lambda c: naive_bayes.naive_bayes_categorical_cv(c.rows, c.y[0], c.x, c.p["n_splits"], c.ordered, {v: [str(e) for e in c.enums.get(v, [])] for v in c.x}),
    "naive_bayes_gaussian_cv": lambda c: naive_bayes.naive_bayes_gaussian_cv(c.rows, c.y[0], c.x, c.p["n_splits"], c.ordered),
    "pca": lambda c: correlation.pca(c.rows, c.y),
    "pca_with_transformation": lambda c: correlation.pca_with_transformation(c.rows, c.y, c.p.get("data_transformation")),
    "pearson_correlation": lambda c: correlation.pearson_correlation(c.rows, c.y, c.x or None, c.p["alpha"]),
    "svm_scikit": _svm,
    "ttest_independent": lambda c: ttests.ttest_independent(c.rows, c.y[0], c.x[0], **c.p),
    "ttest_onesample": lambda c: ttests.ttest_onesample(c.rows, c.y[0], **c.p),
    "ttest_paired": lambda c: ttests.ttest_paired(c.rows, c.x[0], c.y[0], **c.p),
    "logistic_regression_fedaverage_flower": lambda c: {"accuracy": federated.fedavg_logistic(c.rows, *c.matrix()[1:], evaluate=c.held_out)["accuracy"]},
    "xgboost": _trees,
}
