"""The registered queries of the document-transformation operators."""

from __future__ import annotations

from loomframe.plans import formats, scalars, tables  # noqa: F401
from loomframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
