"""Every registered query with its SQL twin."""

from importlib import import_module

from .base import REGISTRY

MODULES = ("q_windows", "q_timeline", "q_ranking", "q_audit", "q_rows", "q_experiments", "q_sources", "q_models", "q_trees")


def load():
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY
