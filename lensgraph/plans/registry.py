"""All registered queries and their SQL."""

from __future__ import annotations

from lensgraph.plans import graphs, indexing, models, networks, reports, services, vectors

MODULES = (graphs, networks, vectors, indexing, reports, models, services)


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL, where SQL can express it."""
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
