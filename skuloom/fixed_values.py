"""Fixed values.

Markers, patterns, word lists, labels and weights that have to be exactly these
for the results to be right. Patterns use Java syntax; ``(?U)`` switches the
character classes to Unicode.
"""

# --- text -------------------------------------------------------------------
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
LEADING_WHITESPACE = r"(?U)^[\s\x1c-\x1f]+"
LINE_BREAKS = r"[\r\n]+"
SPEC_KEY_MAX = 60

# --- embedded data ----------------------------------------------------------
CATEGORY_MARKER = "window.algoliaConfig ="
VARIANTS_MARKER = "window.masterData ="
IMAGES_MARKER = "initialImages:"
LD_PRODUCT = "Product"
LD_BREADCRUMB = "BreadcrumbList"
CATEGORY_SEPARATOR = "///"
PLACEHOLDER = "placeholder"

# --- prices -----------------------------------------------------------------
PRICE_KEYS = ("product_price", "price", "lowPrice", "default", "USD")
PRICE_ATTRIBUTE = r"""data-price-amount=["']([0-9.]+)"""
PRICE_DOLLAR = r"\$([0-9,.]+)"
PRICE_BARE = r"^\s*([0-9.]+)\s*$"
DEFAULT_CURRENCY = "USD"

# --- availability -----------------------------------------------------------
AVAILABILITY = {
    "InStock": "In stock",
    "OutOfStock": "Out of stock",
    "PreOrder": "Preorder",
}

# --- pack size rules, tried in this order -----------------------------------
PACK_SIZE_PATTERNS = (
    r"(?iU)\b\d[\d,]*\s*(?:gloves?|pieces?|pcs?)?\s*(?:/|per\s+)"
    r"(?:bag|box|pack|case|pkg|package)\b",
    r"(?iU)\b(?:bag|box|pack|case|pkg|package)\s+of\s+\d[\d,]*\b",
    r"(?iU)\b\d[\d,]*\s*(?:ct|count)\b",
)
PACK_SOURCE_RULE = "rule"
PACK_SOURCE_MODEL = "llm"

# --- pack claims ------------------------------------------------------------
MATCH_LEADING_DOT = r"(?<!\d)\.(?=\d)"
MATCH_TOKEN = r"(?U)\d+(?:\.\d+)?|[a-z]+"
MATCH_ALIASES = {
    "bags": "bag",
    "boxes": "box",
    "bx": "box",
    "packs": "pack",
    "cases": "case",
    "cs": "case",
    "pkgs": "package",
    "pkg": "package",
    "packages": "package",
    "pairs": "pair",
    "pieces": "piece",
    "pcs": "piece",
    "pc": "piece",
    "items": "item",
    "gloves": "glove",
    "counts": "count",
    "ct": "count",
    "sleeves": "sleeve",
    "bottles": "bottle",
    "jars": "jar",
    "syringes": "syringe",
    "kits": "kit",
    "vials": "vial",
    "tubes": "tube",
    "cc": "ml",
}
CLAIM_NOISE = (
    r"\bhold(?:s|ing)? \d+(?:\.\d+)? "
    r"(?:bag|box|pack|case|package|pair|piece|item|glove)\b",
    r"\b\d+(?:\.\d+)? ml priming volume\b",
    r"\b\d+(?:\.\d+)? drops? (?:per )?ml\b",
)
CONTAINERS = "bag|box|pack|case|package|sleeve|bottle|jar|syringe|kit|vial|tube"
INNER_UNITS = "pair|piece|item|glove|bag|box|syringe|vial|tube"
CLAIM_COUNT = rf"\b(\d+)(?: (?:{INNER_UNITS}))?(?: per)? ({CONTAINERS})\b"
CLAIM_CONTAINER_OF = rf"\b({CONTAINERS}) of (\d+)\b"
CLAIM_MEASURE = r"\b(\d+(?:\.\d+)?) (?:(?:fl|fluid) )?(ml|oz|g|mg)\b"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
COUNT_UNITS = (
    "bag|box|pack|case|package|sleeve|pair|piece|item|"
    "glove|bottle|jar|syringe|kit|vial|tube"
)
VERBAL_COUNT = rf"\b(?:{NUMBER_WORDS}) (?:{COUNT_UNITS})\b"
VERBAL_EACH = r"\beach\b"
PACK_DESCRIPTOR = (
    r"^(?:standard|starter|refill|multiuse) (?:package|pack|kit)$"
)
PACK_CONFIDENCE_THRESHOLD = 0.65

# --- similar products -------------------------------------------------------
TAG_WEIGHT = 0.65
LEAF_WEIGHT = 0.25
BRAND_WEIGHT = 0.10
MIN_SCORE = 0.45
MAX_ALTERNATIVES = 3
REASON_SHARED = "Shared normalized tags: "
REASON_CATEGORY = "Same catalog category"
ALTERNATIVE_SOURCE = "inferred"
ALTERNATIVE_METHOD = "llm_normalized_tags_v1"

# --- validation and failure log ---------------------------------------------
REQUIRED_FIELDS = ("sku", "product_name", "product_url")
UNKNOWN_URL = "<unknown>"
STAGE_DISCOVERY = "category_discovery"
STAGE_TRAVERSAL = "category_traversal"
STAGE_EXTRACTION = "product_extraction"
STAGE_ENRICHMENT = "ai_enrichment"
STAGE_VALIDATION = "validation"
