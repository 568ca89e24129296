"""Registered queries, one module per operator family."""

from importlib import import_module

MODULES = ("scalars", "sources", "quality", "joins", "comparables", "stats", "windows", "finance", "market", "models", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"hearthframe.plans.{name}")
