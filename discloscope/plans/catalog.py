"""Imports every plan module, which fills the registry."""

from discloscope.plans import (  # noqa: F401
    cleaning_plans,
    feature_plans,
    matrix_plans,
    model_plans,
    relational_plans,
    reply_plans,
    text_plans,
    timeseries_plans,
)
from discloscope.plans.registry import QUERIES

__all__ = ["QUERIES"]
