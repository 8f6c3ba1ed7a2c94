"""All registered queries of the library, and their SQL."""

from .plans import q_clean, q_metrics, q_rollups, q_samplers, q_sources, q_temporal, q_vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
