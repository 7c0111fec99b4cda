"""What this subpackage adds to the driver contract."""

from __future__ import annotations

from inkfold.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
