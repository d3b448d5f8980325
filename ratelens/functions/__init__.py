"""Column expressions: everything here stays JVM-side (no Python UDF)."""

from ratelens.functions.scalar import (round_even, safe_ratio, pct_text, money_text, count_text,
                                       risk_tier, risk_factors, RISK_TIERS)
from ratelens.functions.bins import (cut_expr, cut_index_expr, equal_width_edges, interval_breaks,
                                     money_label)

__all__ = ["round_even", "safe_ratio", "pct_text", "money_text", "count_text", "risk_tier",
           "risk_factors", "RISK_TIERS", "cut_expr", "cut_index_expr", "equal_width_edges",
           "interval_breaks", "money_label"]
