"""Import every query module so that its registrations run."""

from panelspark.queries import analyses, discovery, relational, sourcing, study, timeseries  # noqa: F401
from panelspark.queries.base import REGISTRY, run

__all__ = ["REGISTRY", "run"]
