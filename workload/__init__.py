"""Queries over the given tables, each with the SQL that states its expected result."""

from workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]


def load() -> None:
    """Import the modules that register queries."""
    from workload import documents, evaluation, labelling, profiles, schemas, storage  # noqa: F401
