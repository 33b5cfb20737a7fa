"""Runnable queries, one per operator, over the tables of a scale-factor directory."""

import importlib

AREAS = ["decisions", "statistics", "labelling", "evaluation", "scales", "filing", "curves", "pixels", "storage"]


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"granulith.plans.{area}")


def queries() -> dict:
    from granulith.plans.registry import QUERIES
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    from granulith.plans.registry import ORACLES
    _load()
    return dict(ORACLES)


def flagship(spark, sf_dir):
    return queries()["e00_size_report"](spark, sf_dir)
