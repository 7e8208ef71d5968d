"""python -m cohortstats -a ALGORITHM -m MODEL -d DATASETS -y VARS [-x VARS] [-f JSON] [-p K=V ...] [-r FILE] --data FOLDER

-r reads a request as JSON (- for standard input); what the other options give replaces its parts."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.csv_models import find_models, load_model


def guess(text: str):
    """int, float, JSON (so true and false, too), or the text as it is."""
    for cast in (int, float, json.loads):
        try:
            return cast(text)
        except ValueError:
            continue
    return text


def read(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path) as file:
        return file.read()


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    for flag, name in (("-a", "algorithm"), ("-m", "model"), ("-d", "datasets"), ("-y", "y"), ("-x", "x"), ("-f", "filters")):
        p.add_argument(flag, f"--{name}", default="")
    p.add_argument("-p", "--parameters", nargs="*", default=[])
    p.add_argument("-r", "--request", default="")
    p.add_argument("--data", required=True)
    p.add_argument("--min-rows", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, min_rows=a.min_rows)
    for folder, csvs in find_models(spark, a.data).items():
        engine.register(*load_model(spark, folder, csvs))
    listed = lambda s: [v for v in s.split(",") if v]
    request = json.loads(read(a.request)) if a.request else {}
    given = {"data_model": a.model, "datasets": listed(a.datasets), "y": listed(a.y), "x": listed(a.x), "filters": json.loads(a.filters) if a.filters else None}
    request["inputdata"] = {**given, **(request.get("inputdata") or {}), **{k: v for k, v in given.items() if v}}
    request["inputdata"]["filters"] = request["inputdata"]["filters"] or None  # an empty text is no filter
    request["parameters"] = {**(request.get("parameters") or {}), **{k: guess(v) for k, _, v in (s.partition("=") for s in a.parameters)}}
    out = engine.run_json(a.algorithm, request)
    print(out)
    return out


if __name__ == "__main__":
    main()
