"""Registered queries over the driver's tables, and their SQL counterparts."""

from importlib import import_module

MODULES = ["accounts", "rankings", "ownership", "searching", "reconciling", "texts", "keywords", "profiles", "streams", "loading", "filesources"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"checks.{name}")
