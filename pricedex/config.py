"""Fixed values of the method, in one place."""

from __future__ import annotations

# Thresholds, windows and vocabularies that results must agree with.
LAG_DAYS = 7
TIER1_STABILITY, TIER2_STABILITY = 0.70, 0.40
MIN_MATCHED = 3
MIN_OUTLIER_ITEMS = 5
MAD_MULTIPLIER = 5.0
BASE_LEVEL = 100.0
MAX_FRESHNESS_DAYS = 13
MAX_IMPUTATION = 0.40
IMPUTATION_WINDOW_DAYS = 56
FINAL_AFTER_DAYS = 3
MIN_ROUTE_COVERAGE = 0.60
SUPPRESSED_WEIGHT_CAVEAT = 0.15
TIER3_WEIGHT_CAVEAT = 0.25
FRESHNESS_P90_CAVEAT = 6
TOLERANCE = 1e-12
HOUR_BAND = 3
CONTRACT_BANDS = (2, 3, 4, 5, 6)
COLLECTION_WINDOW = (6 * 60, 22 * 60)
LEAD_BUCKETS = (1, 3, 7, 15, 30, 45, 60)
RECONCILE_TOLERANCE = 1.00
UNLISTED_RANK = 1 << 30
OUTCOMES = ("SUCCESS", "NO_FLIGHT", "STRUCTURAL_MISSING", "TECHNICAL_FAILURE", "SOURCE_UNAVAILABLE", "PARSER_FAILURE", "CAPTCHA_OR_ANTIBOT_STOP", "PERMISSION_BLOCKED")
COLLECTOR_FAILURES = ("SOURCE_UNAVAILABLE", "PARSER_FAILURE", "CAPTCHA_OR_ANTIBOT_STOP", "PERMISSION_BLOCKED")
MARKET_FACTS = ("NO_FLIGHT", "STRUCTURAL_MISSING", "TECHNICAL_FAILURE")
STOP_SIGNAL = "CAPTCHA_OR_ANTIBOT_STOP"
