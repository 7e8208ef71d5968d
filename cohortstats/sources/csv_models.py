"""Data models on disk: a folder with CDEsMetadata.json and CSVs, loaded as one wide table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest

_TYPES = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType()}


@dataclass(frozen=True)
class CDE:
    """A common data element: what a column of a data model means."""

    code: str
    label: str = ""
    sql_type: str = "text"
    is_categorical: bool = False
    enumerations: dict[str, str] = field(default_factory=dict)
    min: float | None = None
    max: float | None = None

    @classmethod
    def of(cls, v: dict[str, Any]) -> CDE:
        enums = {e["code"]: e.get("label", e["code"]) for e in v.get("enumerations") or []}
        return cls(v["code"], v.get("label", v["code"]), v.get("sql_type", "text"), bool(v.get("isCategorical", v.get("is_categorical", False))), enums, v.get("minValue", v.get("min")), v.get("maxValue", v.get("max")))

    def field(self) -> T.StructField:
        meta = {"label": self.label, "is_categorical": self.is_categorical, "enumerations": json.dumps(self.enumerations)}
        return T.StructField(self.code, _TYPES[self.sql_type], True, meta)


@dataclass(frozen=True)
class DataModel:
    code: str
    version: str
    cdes: dict[str, CDE]
    label: str = ""
    longitudinal: bool = False
    tags: tuple[str, ...] = ()
    properties: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.code}:{self.version}"

    @property
    def table(self) -> str:
        """The name with what SQL identifiers don't hold as underscores."""
        return "".join("_" if c in ":-." else c for c in self.name)


def _variables(group: dict[str, Any]) -> list[dict[str, Any]]:
    return [*group.get("variables", []), *[v for g in group.get("groups", []) for v in _variables(g)]]


def parse_metadata(text: str) -> DataModel:
    """A data model from its JSON; groups are flattened in order."""
    m = json.loads(text)
    if not m.get("code") or not m.get("version"):
        raise BadRequest("A data model needs code and version.")
    return DataModel(m["code"], m["version"], {v["code"]: CDE.of(v) for v in _variables(m)}, m.get("label", ""), bool(m.get("longitudinal")), tuple(m.get("tags", ())), m.get("properties") or {})


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def find_models(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Folders that hold a model (the root or one below it) and their CSVs, sorted; by Spark's file systems."""
    fs, path = _fs(spark, root)
    out = {}
    for folder in [path, *sorted((s.getPath() for s in fs.listStatus(path) if s.isDirectory()), key=str)]:
        names = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.isFile())
        csvs = [n for n in names if n.endswith(".csv")]
        if csvs and any(n.endswith("/CDEsMetadata.json") for n in names):
            out[folder.toString()] = csvs
    return out


def read_metadata(spark: SparkSession, folder: str) -> DataModel:
    return parse_metadata("\n".join(r[0] for r in spark.read.text(f"{folder}/CDEsMetadata.json", wholetext=True).collect()))


def read_csv(spark: SparkSession, path: str, model: DataModel, number: int = 0) -> DataFrame:
    """One CSV with the model's declared types; columns that the model lacks stay strings, and every row gets
    the ordinal that cross-validation orders by: the file's number among the model's, then the row's place."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    cast = [F.expr(f"try_cast(`{c}` as {model.cdes[c].field().dataType.simpleString()})").alias(c) if c in model.cdes else F.col(f"`{c}`") for c in raw.columns]
    return raw.select(*cast, F.lit(path).alias("__file"), (F.lit(number << 50) + F.monotonically_increasing_id()).alias("__ordinal"))


def load_model(spark: SparkSession, folder: str, csvs: list[str] | None = None) -> tuple[DataModel, DataFrame]:
    """The model and its table: all CSVs, columns that one lacks null there. A dataset may not span files."""
    model = read_metadata(spark, folder)
    frames = [read_csv(spark, c, model, k) for k, c in enumerate(csvs or next(iter(find_models(spark, folder).values())))]
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    check_datasets(table)
    return model, table


def datasets(table: DataFrame) -> DataFrame:
    """Distinct non-blank dataset names, trimmed."""
    return table.select(F.trim("dataset").alias("dataset")).where(F.length("dataset") > 0).distinct()


def check_datasets(table: DataFrame) -> None:
    if "dataset" not in table.columns:
        return
    twice = table.where(F.length(F.trim("dataset")) > 0).groupBy(F.trim("dataset").alias("d")).agg(F.count_distinct("__file").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"Dataset '{twice[0].d}' appears in more than one CSV of its data model.")


def write_model(model: DataModel, table: DataFrame, path: str) -> None:
    """The table as Parquet, a folder a dataset, so that requests for datasets read only theirs."""
    table.write.mode("overwrite").partitionBy("dataset").parquet(path)


def metadata_frames(spark: SparkSession, models: list[DataModel], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The catalogue as small tables: data_models, datasets and variables."""
    rows = [(m.name, m.code, m.version, m.label, "ENABLED", m.longitudinal) for m in models]
    out = {"data_models": spark.createDataFrame(rows, "data_model string, code string, version string, label string, status string, longitudinal boolean")}
    named = [datasets(tables[m.name]).select(F.lit(m.name).alias("data_model"), "dataset", F.lit("ENABLED").alias("status")) for m in models]
    out["datasets"] = reduce(DataFrame.union, named)
    cdes = [(m.name, c.code, c.label, c.sql_type, c.is_categorical, json.dumps(c.enumerations), c.min, c.max) for m in models for c in m.cdes.values()]
    out["variables"] = spark.createDataFrame([(*c[:6], None if c[6] is None else float(c[6]), None if c[7] is None else float(c[7])) for c in cdes], "data_model string, code string, label string, sql_type string, is_categorical boolean, enumerations string, min double, max double")
    return out


def enabled_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """data_model and dataset of what is enabled, of models that are enabled."""
    models = frames["data_models"].where("status = 'ENABLED'").select("data_model")
    return frames["datasets"].where("status = 'ENABLED'").join(F.broadcast(models), "data_model", "left_semi").select("data_model", "dataset")


def healthcheck(spark: SparkSession) -> bool:
    return spark.range(1).select(F.lit("HEALTHCHECK").alias("h")).first()["h"] == "HEALTHCHECK"


def enlarge(table: DataFrame, factor: int) -> DataFrame:
    """Every row ``factor`` times, for tests of size."""
    return table.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(factor)))).drop("__copy")
