"""Loads every query module and exposes the filled registry."""

from siteseries.plans import projection, joining, grouping, windows, domain, statistics, modelling  # noqa: F401
from siteseries.plans.registry import QUERIES, SQL  # noqa: F401
