"""Composite views, snapshots, and the registered queries."""

from . import archived, catalog, history  # noqa: F401
