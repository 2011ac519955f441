"""Every registered query of the engine and the SQL it is checked against."""

from __future__ import annotations

from . import metadata, physical, star

QUERIES = star.QUERIES | metadata.QUERIES | physical.QUERIES
ORACLES = star.ORACLES | metadata.ORACLES | physical.ORACLES
