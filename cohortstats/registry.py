"""Algorithms that plug-in modules add to an engine."""

from __future__ import annotations

import importlib.util
import inspect
import sys
from abc import ABC, abstractmethod
from collections.abc import Iterable
from hashlib import sha256
from pathlib import Path
from typing import Any, ClassVar

from .specs import Spec, check_spec


class Algorithm(ABC):
    """A subclass names its spec and answers a call; the engine builds the rows by the flags.

    ``drop_na_rows``: rows with a null variable go. ``check_min_rows``: sites of too few rows go.
    ``add_dataset_variable``: the rows keep their data set as a column.
    """

    spec: ClassVar[Spec]
    drop_na_rows: ClassVar[bool] = True
    check_min_rows: ClassVar[bool] = True
    add_dataset_variable: ClassVar[bool] = False

    @abstractmethod
    def run(self, call) -> dict[str, Any]:
        """The JSON-ready result; ``call`` has rows, y, x, p (parameters), enums and min_rows."""


def algorithms_in(folders: Iterable[str]) -> list[type[Algorithm]]:
    """The algorithms that the folders' Python files define, by file name and place."""
    out = []
    for path in sorted(p for folder in folders for p in Path(folder).glob("*.py") if not p.name.startswith("_")):
        name = f"{path.stem}_{sha256(str(path.resolve()).encode()).hexdigest()[:8]}"
        found = importlib.util.spec_from_file_location(name, path)
        module = importlib.util.module_from_spec(found)
        sys.modules[name] = module
        found.loader.exec_module(module)
        out += [c for c in vars(module).values() if inspect.isclass(c) and issubclass(c, Algorithm) and not inspect.isabstract(c) and c.__module__ == name]
    return out


def checked(algorithm: type[Algorithm], taken: Iterable[str]) -> type[Algorithm]:
    """The algorithm, if its spec holds and its name is free."""
    if not isinstance(getattr(algorithm, "spec", None), Spec):
        raise ValueError(f"{algorithm.__qualname__} has no spec.")
    if check_spec(algorithm.spec).name in taken:
        raise ValueError(f"Algorithm '{algorithm.spec.name}' exists already.")
    return algorithm
