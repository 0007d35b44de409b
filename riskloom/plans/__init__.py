"""Queries over the test tables, each with the SQL that must give the same rows."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package so its queries are registered."""
    for module in pkgutil.iter_modules(__path__, f"{__name__}."):
        importlib.import_module(module.name)
