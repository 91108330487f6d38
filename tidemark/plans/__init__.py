"""Named queries over the base tables, one module per operator group."""

import importlib

MODULES = [
    "columns",
    "profiling",
    "dictionary",
    "retrieval",
    "questions",
    "catalog",
    "files",
    "streams",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
