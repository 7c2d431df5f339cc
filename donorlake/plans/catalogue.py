"""All registered queries."""

from __future__ import annotations

from . import analysis, cohorts, files, literature, loading, preparation, text, textarms  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
