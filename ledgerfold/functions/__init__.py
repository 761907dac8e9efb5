"""Column-expression helpers (all JVM-side, codegen friendly)."""

from ledgerfold.functions.nullsafe import (  # noqa: F401
    cents,
    clip_lower,
    cut_right_closed,
    days_to_years,
    exact_mean,
    exact_var_samp,
    is_integral,
    not_equal_keep_null,
    rowwise_flag_count,
    rowwise_max,
    rowwise_mean,
    rowwise_min,
    rowwise_product,
    rowwise_std,
    safe_divide,
    sentinel_to_null,
    sum0,
)
from ledgerfold.functions.names import clean_name, clean_names  # noqa: F401
