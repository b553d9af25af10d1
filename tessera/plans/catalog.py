"""All queries of the measurement operators."""

from . import corpus_plans, entry_plans, label_plans, latent_plans, measure_plans, more_plans, text_plans  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
