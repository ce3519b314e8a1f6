from cohortkit.functions.columns import qcol, coerce_numeric_expr, na_token_expr  # noqa: F401
from cohortkit.functions.formatting import (  # noqa: F401
    format_p_value, format_mean_sd, format_metric_pm, significance_stars, round_metrics, pct,
)
from cohortkit.functions.hashing import hash_hex, uniform  # noqa: F401
