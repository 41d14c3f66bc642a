"""All registered queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from siftline import queries as modules
from siftline.registry import QUERIES, SQL


def _load() -> None:
    for found in pkgutil.iter_modules(modules.__path__):
        importlib.import_module(f"{modules.__name__}.{found.name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)
