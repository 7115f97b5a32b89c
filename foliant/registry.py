"""All queries of the library, by name, with their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> (spark, sf_dir) -> DataFrame) and ORACLES (name -> DuckDB SQL).
MODULES: list[str] = [
    "foliant.plans.money",
    "foliant.plans.lists",
    "foliant.plans.linking",
    "foliant.plans.pages",
    "foliant.plans.parsing",
    "foliant.plans.checks",
    "foliant.plans.fields",
    "foliant.plans.documents",
    "foliant.plans.regions",
    "foliant.plans.repairs",
    "foliant.plans.cells",
    "foliant.plans.labels",
    "foliant.plans.domains",
    "foliant.plans.values",
]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLES.items()}


def FLAGSHIP(spark, sf_dir):  # noqa: N802
    """The reconciliation of documents with their lines."""
    return queries()["monetary_reconciliation"](spark, sf_dir)
