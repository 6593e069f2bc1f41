"""Queries over the tables, by inventory number."""


def all_queries() -> dict:
    from tessera.plans import domain, records, relational, rules, silver, storage  # noqa: F401  they register
    from tessera.plans.registry import QUERIES

    return QUERIES


def all_oracles() -> dict:
    all_queries()
    from tessera.plans.registry import ORACLES

    return ORACLES
