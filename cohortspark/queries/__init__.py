"""Registered queries by area; importing the modules fills the registry."""

from __future__ import annotations

from importlib import import_module

AREAS = ("layers", "quality", "joins", "aggregates", "ranking", "profiling", "evaluation", "modelling", "interpretation", "territory")


def load():
    for area in AREAS:
        import_module(f"cohortspark.queries.{area}")
    registry = import_module("cohortspark.queries.registry")
    return dict(registry.QUERIES), dict(registry.ORACLE)
