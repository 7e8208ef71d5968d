"""Two visits of a subject as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadUserInput

STRATEGIES = ("first", "second", "diff")


def check(variables: list[str], strategies: dict[str, str], categorical: set[str]) -> None:
    if set(variables) ^ set(strategies):
        raise BadUserInput(f"There must be a strategy for each of the variables and no others: {sorted(set(variables) ^ set(strategies))}.")
    for name, how in strategies.items():
        if how not in STRATEGIES:
            raise BadUserInput(f"{how} is no strategy.")
        if how == "diff" and name in categorical:
            raise BadUserInput(f"Cannot take the difference for the nominal variable '{name}'.")


def renamed(variables: list[str], strategies: dict[str, str]) -> list[str]:
    return [f"{v}_diff" if strategies[v] == "diff" else v for v in variables]


def pair_visits(df: DataFrame, visit1, visit2, strategies: dict[str, str], subject: str = "subjectid", visit: str = "visitid", also: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Inner join of the rows of two visits on subject (and dataset, where there): first, second or the difference of each variable."""
    keys = [subject, *[c for c in also if c in df.columns]]
    names = list(strategies)
    one = df.where(F.col(visit) == visit1).select(*keys, *[F.col(f"`{c}`").alias(f"{c}__1") for c in names])
    two = df.where(F.col(visit) == visit2).select(*keys, *[F.col(f"`{c}`").alias(f"{c}__2") for c in names])
    how = {
        "first": lambda c: F.col(f"{c}__1").alias(c),
        "second": lambda c: F.col(f"{c}__2").alias(c),
        "diff": lambda c: (F.col(f"{c}__2") - F.col(f"{c}__1")).alias(f"{c}_diff"),
    }
    return one.join(two, keys, "inner").select(*keys, *[how[strategies[c]](c) for c in names])
