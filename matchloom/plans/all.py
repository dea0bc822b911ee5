"""Imports every module of registered queries."""

from . import columns, matching, sources, spatial, state, streams  # noqa: F401
