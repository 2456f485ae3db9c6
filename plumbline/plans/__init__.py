"""Registered queries, grouped by area."""

from importlib import import_module

AREAS = ["evaluation", "comparison", "calibrating", "sampling", "guarding", "publishing", "ruling", "converting", "combining"]


def _load():
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    return import_module(f"{__name__}.registry")


def all_queries():
    return _load().QUERIES


def all_oracles():
    return _load().ORACLE
