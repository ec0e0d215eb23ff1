"""Every operator as a query over the given tables, most with the same question in SQL."""

from importlib import import_module

from penprint.catalog.base import QUERIES, Query

GROUPS = ("texts", "sentences", "profiles", "parsing", "induction", "emotions", "fills", "rewrites", "requests")


def all_queries() -> dict[str, Query]:
    for group in GROUPS:
        import_module(f"penprint.catalog.{group}")
    return QUERIES
