"""Import every query module so the registry is filled."""

from critiq.plans import q_alerts, q_explore, q_ml, q_prep, q_sequential, q_sinks, q_sources, q_tabular, q_text  # noqa: F401
from critiq.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
