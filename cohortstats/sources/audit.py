"""Federation events (workers, models, datasets, experiments) out of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed forms of the log lines: action and the pattern whose groups are its subjects.
EVENTS = (
    ("worker_joined", r"Worker with id '([^']*)' joined"),
    ("worker_left", r"Worker with id '([^']*)' left"),
    ("data_model_added", r"Datamodel '([^']*)' was added"),
    ("data_model_removed", r"Datamodel '([^']*)' was removed"),
    ("dataset_added", r"Dataset '([^']*)' of datamodel '([^']*)' was added"),
    ("dataset_removed", r"Dataset '([^']*)' of datamodel '([^']*)' was removed"),
    ("experiment_started", r"Experiment with request id '([^']*)' and context id '[^']*' is starting algorithm '([^']*)'"),
)
_STAMP = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"


def events(lines: DataFrame, column: str = "value") -> DataFrame:
    """at, action, subject and other of every line that is an event; all other lines are left out."""
    c = F.col(column)
    action = subject = other = F.lit(None).cast("string")
    for name, pattern in reversed(EVENTS):
        hit = c.rlike(pattern)
        action = F.when(hit, F.lit(name)).otherwise(action)
        subject = F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(subject)
        other = F.when(hit, F.regexp_extract(c, pattern, 2) if pattern.count("(") - pattern.count("\\(") > 1 else F.lit(None)).otherwise(other)
    out = lines.select(F.try_to_timestamp(F.regexp_extract(c, _STAMP, 1)).alias("at"), action.alias("action"), subject.alias("subject"), other.alias("other"))
    return out.where("action is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return events(spark.read.text(path))
