"""Registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import checks, composites, dispatch, measures, models, people, rolling, scalar, sets, space, storage, streams
from .base import ORACLES, QUERIES

MODULES = (checks, composites, dispatch, measures, models, people, rolling, scalar, sets, space, storage, streams)


def flagship(spark, sf_dir):
    """How many trips from each station were visible at each tick."""
    return rolling.j05(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
