"""All queries by name."""

from opsdiff.checks import scalars, streams, tables, texts  # noqa: F401
from opsdiff.checks.base import CHECKS

__all__ = ["CHECKS"]
