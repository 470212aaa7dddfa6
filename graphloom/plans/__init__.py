"""Query plans over the driver tables: the registry behind ``__spark_entry__``."""

from .registry import ORACLE, QUERIES, load_all


def queries() -> dict:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict:
    load_all()
    return dict(ORACLE)
