"""Corpus operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> (spark, sf_dir) -> DataFrame) and ORACLES (name -> DuckDB SQL).
MODULES = [
    "quality_rules",
    "token_files",
    "simhash",
    "language_id",
    "toxicity",
    "decontamination",
    "lm_scoring",
    "suffix_dedup",
    "mixing",
    "line_dedup",
    "lexical_search",
    "jaccard_join",
    "spelling",
]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLES.items()}
