"""Import every query family so the registry is complete."""
from . import (q_forecast, q_gaps, q_insights, q_kpi, q_logs, q_metrics, q_ml, q_profile, q_quality, q_scalars,  # noqa: F401
               q_sources, q_stats)
from .registry import ORACLES, QUERIES  # noqa: F401
