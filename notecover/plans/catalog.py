"""Import every query module so that the registry is complete."""

from __future__ import annotations

from notecover.plans import q_chains, q_eval, q_model, q_prep, q_text  # noqa: F401
from notecover.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
