"""Name to query, and name to SQL."""

from __future__ import annotations

from ..streaming import windows
from . import features, files, graphs, groups, neighbours, objects, preparation, scores, voxels

MODULES = (voxels, neighbours, graphs, scores, objects, groups, features, preparation, files, windows)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
