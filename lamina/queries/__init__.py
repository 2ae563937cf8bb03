"""The registered queries, each with its SQL where SQL expresses it."""

from . import arrays, fourier, geometry, rasters, volumes, workloads  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
