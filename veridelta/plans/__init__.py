"""Registered queries over the driver tables, with their SQL."""

import importlib

#: The modules that register queries.
MODULES = ("base", "texts", "scores", "retrieval", "flows", "generation", "reports", "models", "samples")


def load():
    """Import every module of queries and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
