"""Named queries and their SQL."""

from __future__ import annotations


def _load():
    from learntrail.plans import attempts, compare, extra, log, models, relations, texts  # noqa: F401

    return log


def queries():
    return _load().QUERIES


def oracle_sql():
    return _load().SQL
