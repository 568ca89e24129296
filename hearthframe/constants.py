"""Thresholds, tolerances and lookup tables that decide results."""

# Comparable selection.
LOOKBACK_MONTHS = 24
RECENCY_HALF_LIFE_MONTHS = 6
LEASE_TOLERANCE_YEARS = 3
# tier name, area limit (m2), storey limit, radius (m), minimum sales
TIERS = (
    ("same_block_similar_24m", 5.0, 3.0, None, 3),
    ("nearby_similar_24m", 10.0, 6.0, 1000.0, 5),
    ("town_similar_model_24m", 15.0, 6.0, None, 8),
    ("town_similar_24m", 20.0, 9.0, None, 10),
)
FALLBACK_TIER = "town_flat_type_fallback"

# Geometry.
EARTH_DIAMETER_M = 12_742_000.0
WITHIN_RADIUS_M = 1000.0
LAT_BOUNDS = (1.1, 1.6)
LON_BOUNDS = (103.5, 104.2)

# Splits and bands.
TEST_MONTHS = 12
VALIDATION_MONTHS = 24
LEASE_TERM_MONTHS = 1188
LEASE_BANDS = ((720, "<60 years"), (840, "60-69 years"), (960, "70-79 years"))
LEASE_BAND_TOP = "80+ years"

# Evaluation and calibration.
MIN_GROUP_SIZE = 30
WATCH_RATIO = 1.25
MIN_CALIBRATION_GROUP = 100
MIN_LOCAL_SALES = 100
COVERAGE_TOLERANCE_PCT = 5.0
ASSOCIATION_CUTS = ((0.50, "strong"), (0.30, "moderate"), (0.10, "weak"))
ETA_CUTS = ((0.25, "large"), (0.09, "medium"), (0.01, "small"))
MAX_SCORED_CATEGORIES = 30

# Listing analysis.
AREA_TOLERANCE_SQM = 8.0
AREA_TOLERANCE_RATIO = 0.12
SQFT_TO_SQM = 0.09290304
RANK_WEIGHTS = (0.50, 0.25, 0.15, 0.10)
PREMIUM_SLOPE = 2.5
OVER_BUDGET_SLOPE = 250.0
LOW_CONFIDENCE_FACTOR = 0.6
NEGOTIATION_MARGIN_PCT = 8.0
LOW_PRICE_MARGIN_PCT = 5.0
DISAGREEMENT_PCT = 15.0

# Repeat sales.
PAIR_AREA_SQM = 5.0
PAIR_STOREYS = 3.0
PAIR_MONTHS = 3
HORIZON_YEARS = (1, 3, 5)
MIN_PAIRS = 30
SCENARIO_GROWTH = (("Pessimistic", -0.02), ("Baseline", 0.02), ("Optimistic", 0.04))

# Finance: marginal duty bands (width, rate); the last band is open.
DUTY_BANDS = (
    (180_000, "0.01"), (180_000, "0.02"), (640_000, "0.03"),
    (500_000, "0.04"), (1_500_000, "0.05"), (None, "0.06"),
)

# Presentation limits.
SCATTER_SAMPLE = 8000
MAP_BLOCKS = 3000
TABLE_ROWS = 500
BIN_COUNT = 50
PRICE_BAND = 100_000
SHORTLIST = 50

# Street-word abbreviations used when whole words of an address are expanded.
STREET_WORDS = {
    "AVE": "AVENUE", "AV": "AVENUE", "CRES": "CRESCENT", "DR": "DRIVE",
    "LN": "LANE", "RD": "ROAD", "ST": "STREET", "NTH": "NORTH",
    "STH": "SOUTH", "CTRL": "CENTRAL", "JLN": "JALAN", "LOR": "LORONG",
    "BT": "BUKIT", "UPP": "UPPER", "CL": "CLOSE", "PL": "PLACE",
}
# The smaller set used for geocoding keys.
GEOCODE_WORDS = {
    "AVE": "AVENUE", "RD": "ROAD", "ST": "STREET", "DR": "DRIVE",
    "CRES": "CRESCENT", "CTRL": "CENTRAL", "UPP": "UPPER",
    "JLN": "JALAN", "LOR": "LORONG",
}
# Contract-town codes.
TOWN_CODES = {
    "AMK": "ANG MO KIO", "BB": "BUKIT BATOK", "BD": "BEDOK",
    "BH": "BISHAN", "BM": "BUKIT MERAH", "BP": "BUKIT PANJANG",
    "BT": "BUKIT TIMAH", "CCK": "CHOA CHU KANG", "CL": "CLEMENTI",
    "CT": "CENTRAL AREA", "GL": "GEYLANG", "HG": "HOUGANG",
    "JE": "JURONG EAST", "JW": "JURONG WEST", "KWN": "KALLANG/WHAMPOA",
    "MP": "MARINE PARADE", "PG": "PUNGGOL", "PRC": "PASIR RIS",
    "QT": "QUEENSTOWN", "SB": "SEMBAWANG", "SGN": "SERANGOON",
    "SK": "SENGKANG", "TAP": "TAMPINES", "TG": "TENGAH",
    "TP": "TOA PAYOH", "WL": "WOODLANDS", "YS": "YISHUN",
}

# Formats of listing cards. They must match the text of the cards.
CARD_BLOCK = r"(?i)^(\d{1,4}[A-Z]?)\s+(.+)$"
CARD_HEADING = r"(?i)^(?:BLK\s+)?(\d{1,4}[A-Z]?)\s+(.+)$"
CARD_PRICE = r"^S\$\s*([\d,]+)$"
CARD_AREA = r"(?i)\b([\d,]+)\s*sqft\b"
CARD_LAND = r"(?i)\b([\d,]+)\s*sqft\s*\(land\)"
CARD_STREET = r"(?i)^\d{1,4}[A-Z]?\s+(.+)$"
CARD_BUILT = r"(?i)\bBuilt:\s*(\d{4})\b"
CARD_LEASE = r"(?i)\b(\d+-year Leasehold|Freehold|Prefer Not to Say)\b"
CARD_LISTED = r"(?i)\bListed on\s+(\w+\s+\d{1,2},\s+\d{4})\b"
