"""Registered queries: each runs over whole tables and, where SQL can say the same, carries an independent SQL twin."""

from importlib import import_module

MODULES = ["scalar", "filters", "merging", "reports", "sources_json", "sources_markup", "runs", "published"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
