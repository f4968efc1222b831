"""All registered queries of the library."""

from placeloom.plans import directory, feeds, frames, matching, operations, scalar  # noqa: F401
from placeloom.plans.registry import ORACLES, QUERIES  # noqa: F401
