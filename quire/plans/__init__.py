"""Queries over the sample tables, one per capability."""

from quire.plans import audit, compare, edits, files, forms, geometry, layout, notes, pages, pictures, redact, rowedits, scalars, search, sessions, trees  # noqa: F401
from quire.plans.registry import COVERS, QUERIES, SQL  # noqa: F401
