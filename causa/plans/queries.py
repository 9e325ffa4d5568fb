"""Imports every module that registers queries."""

from causa.plans import cases, documents, normalise, reports, streams  # noqa: F401
