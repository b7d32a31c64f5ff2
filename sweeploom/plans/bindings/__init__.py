"""Queries over the driver's tables; importing the modules fills the registry."""

from . import audits, files, inventories, models, scalars  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
