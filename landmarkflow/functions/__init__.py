"""Column functions (all built-in expressions, no Python UDFs)."""

from landmarkflow.functions.scalars import (  # noqa: F401
    bin_index,
    clip,
    logit,
    range_label,
    safe_ratio,
)
from landmarkflow.functions.timefns import (  # noqa: F401
    HOUR_US,
    ceil_div,
    floor_div,
    hour_boundaries,
    hour_floor,
    hours,
    micros,
)
