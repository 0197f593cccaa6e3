"""Registered queries by area. ``all_queries`` gives them by name."""

from logweir.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    # importing a catalog registers its queries
    from logweir.plans import lines_catalog, logs_catalog, rules_catalog  # noqa: F401

    return QUERIES
