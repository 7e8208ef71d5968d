"""The federation's catalogue: which site holds which data sets of which models."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput
from ..sources.csv_models import CDE, DataModel

LOCAL, GLOBAL = "LOCALWORKER", "GLOBALWORKER"


@dataclass(frozen=True)
class Site:
    name: str
    role: str
    models: dict[str, DataModel]
    datasets: dict[str, dict[str, str]]  # model: dataset code: label


def compatible_models(sites: list[Site]) -> dict[str, DataModel]:
    """Models whose variables agree on all sites that have them, but for the enumeration of dataset, which
    becomes the union over sites (the first label of a code stays). Tags and properties are merged."""
    out: dict[str, DataModel] = {}
    dropped = set()
    for site in sites:
        for name, model in site.models.items():
            if name in dropped:
                continue
            if name not in out:
                out[name] = model
                continue
            known = out[name]
            if _without_datasets(known) != _without_datasets(model):
                dropped.add(name)
                del out[name]
                continue
            out[name] = replace(known, cdes=_joined(known, model), tags=tuple(dict.fromkeys((*known.tags, *model.tags))), longitudinal=known.longitudinal or model.longitudinal, properties=_merged(known.properties, model.properties))
    return out


def _without_datasets(model: DataModel) -> dict[str, CDE]:
    return {c: replace(v, enumerations={}) if c == "dataset" else v for c, v in model.cdes.items()}


def _joined(a: DataModel, b: DataModel) -> dict[str, CDE]:
    if "dataset" not in a.cdes:
        return a.cdes
    enums = {**b.cdes["dataset"].enumerations, **a.cdes["dataset"].enumerations}
    order = dict.fromkeys((*a.cdes["dataset"].enumerations, *b.cdes["dataset"].enumerations))
    return {**a.cdes, "dataset": replace(a.cdes["dataset"], enumerations={k: enums[k] for k in order})}


def _merged(a: dict, b: dict) -> dict:
    """Lists of the distinct values of each property."""
    as_list = lambda v: v if isinstance(v, list) else [v]
    out: dict[str, list] = {}
    for k in {**a, **b}:
        out[k] = []
        for v in as_list(a.get(k, [])) + as_list(b.get(k, [])):
            if v not in out[k]:
                out[k].append(v)
    return out


def locations(sites: list[Site], models: dict[str, DataModel] | None = None) -> dict[str, dict[str, str]]:
    """model: dataset: site; a dataset that several sites hold is nowhere."""
    models = compatible_models(sites) if models is None else models
    found: dict[str, dict[str, list[str]]] = {m: {} for m in models}
    for s in sites:
        for m, ds in s.datasets.items():
            for d in ds if m in models else ():
                found[m].setdefault(d, []).append(s.name)
    return {m: {d: w[0] for d, w in ds.items() if len(w) == 1} for m, ds in found.items()}


def by_role(sites: list[Site], model: str, role: str) -> list[str]:
    """Training data sets are those of local sites, validation ones those of the global site."""
    where = locations(sites)
    if model not in where:
        raise BadUserInput(f"Data model '{model}' is not available.")
    names = {s.name for s in sites if s.role == role}
    return sorted(d for d, s in where[model].items() if s in names)


def sites_of(sites: list[Site], model: str, datasets: list[str]) -> list[str]:
    """Only the sites that hold any of the data sets take part."""
    where = locations(sites).get(model, {})
    return sorted({where[d] for d in datasets if d in where})


def unique_datasets(table: DataFrame, keys: tuple[str, ...] = ("data_model", "dataset"), site: str = "site") -> DataFrame:
    """As a plan: the (model, dataset) pairs that exactly one site holds, and that site."""
    return table.groupBy(*keys).agg(F.count_distinct(site).alias("sites"), F.min(site).alias(site)).where("sites = 1").drop("sites")
