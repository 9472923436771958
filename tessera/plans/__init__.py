"""Registered queries, each with SQL that gives the same rows where SQL can."""

from . import bags, blurs, colour, evaluation, ordered, relational, streams  # noqa: F401  (they register)
from .registry import ORACLE_SQL, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLE_SQL
