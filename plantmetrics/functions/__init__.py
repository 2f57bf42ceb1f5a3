from plantmetrics.functions.dates import (
    half_open_quarter,
    is_business_day,
    iso_week,
    month_label,
    month_start,
    parse_period,
    season_flag,
    week_end,
    weekday0,
)
from plantmetrics.functions.numeric import (
    at_least,
    clip,
    percent,
    round_even,
    round_exact,
    round_to,
    safe_div,
    truncate,
)

__all__ = [
    "at_least",
    "clip",
    "half_open_quarter",
    "is_business_day",
    "iso_week",
    "month_label",
    "month_start",
    "parse_period",
    "percent",
    "round_even",
    "round_exact",
    "round_to",
    "safe_div",
    "season_flag",
    "truncate",
    "week_end",
    "weekday0",
]
