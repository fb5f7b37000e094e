"""Sources and adapters by name: what a site brings in its own folder, then what is installed, then what is built in.

A source is a DataSource class that can be read, an adapter one that can be written; its name() is what `format()` takes.

    folder        classes in <folder>/sources/*.py or <folder>/adapters/*.py (files that begin with _ are left out)
    entry points  installed packages, in the groups `corvane.sources` and `corvane.adapters`
    built in      the page cache, both

The first place that has the name wins. `use` makes the class known to a session; one from a folder is sent to the workers
by value, since they can't import it.
"""

from __future__ import annotations

import importlib.metadata
import importlib.util
import sys
import types
from collections.abc import Iterator
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

from .cachesource import CacheSource

SOURCE, ADAPTER = "source", "adapter"
BUILT_IN: dict[str, list[type[DataSource]]] = {SOURCE: [CacheSource], ADAPTER: [CacheSource]}


def _module(path: Path) -> types.ModuleType:
    name = f"_corvane_{path.parent.name}_{path.stem}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    cloudpickle.register_pickle_by_value(module)
    return module


def _in_folder(kind: str, folder: str) -> Iterator[type[DataSource]]:
    for path in sorted(Path(folder, f"{kind}s").glob("[!_]*.py")):
        module = _module(path)
        for value in vars(module).values():
            if isinstance(value, type) and issubclass(value, DataSource) and value.__module__ == module.__name__:
                yield value


def _installed(kind: str, name: str) -> Iterator[type[DataSource]]:
    for point in importlib.metadata.entry_points(group=f"corvane.{kind}s"):
        if point.name == name:  # others aren't loaded
            yield point.load()


def find(kind: str, name: str, folder: str | None = None) -> type[DataSource]:
    """The class of a source or adapter; LookupError if there is none, with the names there are."""
    local = list(_in_folder(kind, folder)) if folder else []
    for found in local:
        if found.name() == name:
            return found
    for found in _installed(kind, name):
        return found
    for found in BUILT_IN[kind]:
        if found.name() == name:
            return found
    raise LookupError(f"no {kind} {name!r}; there are {', '.join(names(kind, folder)) or 'none'}")


def names(kind: str, folder: str | None = None) -> list[str]:
    local = [c.name() for c in _in_folder(kind, folder)] if folder else []
    return sorted({*local, *(p.name for p in importlib.metadata.entry_points(group=f"corvane.{kind}s")), *(c.name() for c in BUILT_IN[kind])})


def use(spark: SparkSession, kind: str, name: str, folder: str | None = None) -> str:
    """Make a source or adapter known to the session; its name for format()."""
    found = find(kind, name, folder)
    spark.dataSource.register(found)
    return found.name()
