"""Registered queries, grouped like the operators they run."""

from importlib import import_module

MODULES = ("weather", "windows", "joins", "lookups", "quality", "forecast", "evaluation", "learning")


def load_all() -> None:
    for name in MODULES:
        import_module(f"galeframe.plans.{name}")
