"""The registered queries and their SQL."""

from __future__ import annotations

from .plans import algebra, analysis, constraints, equations, files, grids, numerics, ordered, profiles, rays, volumes  # noqa: F401
from .plans.tables import ORACLE_SQL, QUERIES

FLAGSHIP = "prj03_insitu_equations"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
