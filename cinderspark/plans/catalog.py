"""Loads every module of queries."""

from cinderspark.plans import core, files, grids, models, places, reports  # noqa: F401
from cinderspark.plans.registry import QUERIES, SQL  # noqa: F401
