"""All registered queries of the spatial library."""

from cartoflow.plans import io_queries, map_queries, path_queries, points_queries  # noqa: F401  (they register themselves)
from cartoflow.plans.registry import ORACLES, QUERIES  # noqa: F401
