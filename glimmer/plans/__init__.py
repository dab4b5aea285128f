"""Modules whose import registers queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Imports every module of this folder, so that their queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
