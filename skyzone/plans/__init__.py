"""Queries over the driver tables: of the operators, and of sources, checks and releases."""

from . import queries as queries
from . import surfaces as surfaces
from .registry import ORACLES as ORACLES
from .registry import QUERIES as QUERIES
