"""The registered queries over the test tables, each with its SQL counterpart."""

import importlib

MODULES = ["scalars", "filters", "changes", "lookups", "state", "linkage", "ingest", "views", "jobs", "feeds"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"folioflux.workload.{name}")
