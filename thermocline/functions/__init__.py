"""Column expressions (all JVM-side built-ins, usable inside whole-stage codegen)."""

from thermocline.functions.time import (  # noqa: F401
    decimal_year,
    season,
    season_order,
    semi_month_label,
    time_parts,
)
from thermocline.functions.scalar import (  # noqa: F401
    clip_scale,
    exceed_flag,
    maybe_round,
    sorted_array_quantile,
)
