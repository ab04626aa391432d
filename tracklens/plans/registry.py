"""All queries and their reference SQL."""

from importlib import import_module

MODULES = [
    "scenes", "ledger_queries", "parse_queries", "feature_queries", "audit_queries", "selection_queries",
    "evaluation_queries", "model_queries", "file_queries", "stream_queries", "study_queries",
]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        entries = getattr(import_module(f"tracklens.plans.{name}"), attribute)
        repeated = set(found) & set(entries)
        if repeated:
            raise ValueError(f"query registered twice: {sorted(repeated)}")
        found.update(entries)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
