"""All registered queries."""

from plumbline.catalog import data, evaluation, monitoring, records  # noqa: F401
from plumbline.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
