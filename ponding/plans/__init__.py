"""All registered queries of the flood domain, and their SQL."""

from ponding.plans import grid_queries, layer_queries, network_queries, presentation_queries, rain_queries, runoff_queries, source_queries  # noqa: F401
from ponding.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
