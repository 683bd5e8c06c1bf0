"""Fixed values.

Word lists, cut-offs, weights and message texts of the promotion rules. They
decide results, so they are stated here as they must be, in their natural order,
and every function that uses one takes it as a parameter with this default.
"""

# Product families. The first keyword found in the name wins.
FAMILY_BUCKETS = (
    ("avocado", "avocado"),
    ("banana", "banana"),
    ("milk", "milk"),
    ("yogurt", "yogurt"),
    ("egg", "eggs"),
    ("spinach", "spinach"),
    ("strawberr", "strawberries"),
)
FAMILY_STOP_WORDS = (
    "organic", "whole", "reduced", "fat", "free", "range", "large", "grade",
    "nonfat", "lowfat", "greek", "strained", "with", "and", "bag", "of",
)
FAMILY_MIN_WORD = 3
FAMILY_MAX_CHARS = 30
FAMILY_DEFAULT = "other"

# Themes. (where to look, any of these keywords, theme); first match wins.
THEME_RULES = (
    ("anchor", ("yogurt",), "Healthy Breakfast / Smoothie"),
    ("anchor", ("egg",), "Breakfast Essentials"),
    ("anchor", ("avocado",), "Fresh Prep / Cooking (Guac & Sides)"),
    ("items", ("avocado", "lime", "lemon", "cilantro", "onion"),
     "Fresh Prep / Cooking (Guac & Sides)"),
    ("items", ("banana", "strawberr", "blueberr", "raspberr", "spinach", "almond milk"),
     "Healthy Breakfast / Smoothie"),
    ("items", ("sparkling water", "chips", "cookies", "soda"), "Snack & Beverage"),
)
THEME_DEFAULT = "Everyday Staples"

# Placements by words of the theme; first match wins.
PLACEMENT_RULES = (
    (("smoothie", "breakfast"),
     ("Cart upsell", "Product detail page (PDP)", "Weekly deals email/app banner")),
    (("cooking", "prep", "guac"),
     ("Recipe/meal page", "Cart upsell", "Search results badges")),
)
PLACEMENT_DEFAULT = ("Cart upsell", "PDP", "Home page deal tile")

# Cut-offs on the weaker pair count, the anchor's units and its reorder rate.
DISCOUNT_STEPS = ((30000, "Save $1"), (10000, "Save $2"), (4000, "Save $3"))
DISCOUNT_DEFAULT = "Save $4"
CONFIDENCE_STEPS = ((20000, "High"), (6000, "Medium"))
CONFIDENCE_DEFAULT = "Low"
TRIAL_RATE = 0.60
BASKET_AFFINITY = 20000
BASKET_UNITS = 50000
ATTACH_AFFINITY = 6000

IMPACT_TRIAL = "Trial driver (increase conversion for low-repeat shoppers)"
IMPACT_BASKET = "Basket builder (high-likelihood attach; lift AOV)"
IMPACT_ATTACH = "Attach-rate lift (strong pairing; modest discount works)"
IMPACT_DISCOVERY = "Discovery assist (bundle helps shoppers find complementary items)"

OFFER_TRIAL = "BOGO: Buy 1 get 1 50% off (trial driver)"
OFFER_TWO = "Bundle Discount: Buy anchor + 2 add-ons, "
OFFER_ONE = "Bundle Discount: Buy anchor + 1 add-on, "

# Anchor score weights.
ANCHOR_UNITS = 1.0
ANCHOR_RATE = 10000.0
ANCHOR_NAME_CHARS = 25.0
ANCHOR_EXACT = 50000.0
ANCHOR_PLURAL = 40000.0
ANCHOR_PREFIX = 15000.0
ANCHOR_PENALTY = 12000.0
ANCHOR_PENALTY_WORDS = (
    "strawberry", "blueberry", "peach", "vanilla", "chocolate", "alfresco", "stage", "baby",
)
ANCHOR_POOL = 25

# Add-on and pair score weights.
ADDON_COUNT = 1.0
ADDON_RATE = 200.0
ADDON_UNITS_CAP = 5000
ADDON_UNITS_DIVISOR = 50.0
ADDON_SAME_DEPARTMENT = 5000.0
ADDON_PENALTY = 4000.0
ADDON_PENALTY_WORD = "banana"
ADDON_PENALTY_EXEMPT = ("banana", "fruit", "smoothie")
PAIR_SYNERGY = 0.30
CANDIDATE_POOL = 12
PAIR_POOL = 10
BUNDLES_PER_ANCHOR = 3

# Names that a keyword in the query resolves to directly.
ALIASES = (("banana", "Bananas"), ("banana", "Organic Bananas"))

# Corpus indexing and ranking.
TEXT_EXTENSIONS = (".py", ".sql", ".md", ".yml", ".yaml", ".json")
TEXT_SKIP_PREFIXES = ("site/", "venv/", ".venv/", "__pycache__/")
CHUNK_LINES = 200
HEAD_LINES = 400
BLOCK_HEADING = r"^(\s*)(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)\s*[\(:]"
BLOCK_KINDS = (("def", "function"), ("class", "class"))
RANK_TEXT = 50
RANK_SYMBOL = 80
EDGE_STOP_LIST = (
    "print", "len", "min", "max", "sum", "sorted", "enumerate", "range",
    "list", "dict", "set", "tuple", "int", "float", "str", "bool",
    "zip", "map", "filter", "any", "all",
    "append", "extend", "add", "get", "join", "items", "keys", "values",
)

# Message texts.
CARD_USE = "Use: Retail catalog item (SKU) with demand signals for ranking and recommendations."
TEXT_NO_MATCH = (
    "No matching products found. Try a different query "
    "(e.g., 'banana', 'yogurt', 'almond milk')."
)
TEXT_NO_ANCHOR = (
    "Could not identify an anchor product for promotion. Try a different query."
)
TEXT_NO_CANDIDATES = "No bundle candidates found in affinity table."
TEXT_NO_BUNDLES = "Not enough unique candidates to form 3 bundles."
TEXT_HEAD = "Promotion Recommendation (Top 3 Bundles)"
TEXT_ANCHOR = "Anchor SKU:"
TEXT_BUNDLES = "Top 3 promo bundles (Anchor + 2 items):"
TEXT_WHY = (
    "Why these bundles work:",
    "- High co-purchase counts indicate strong basket association (easy upsell).",
    "- High reorder rates imply repeat buying behavior (sticky categories).",
    "- Higher unit volume suggests better promo impact.",
    "- Bundles are diversified to avoid repeating similar add-on items.",
)
TEXT_CHOSEN = "Chosen product (after intent + canonical matching):"
TEXT_TOP_HIT = "Top matching product (semantic search):"
TEXT_NO_PAIRS = "- No strong co-purchase pairs found in affinity table."
# Labels of the lines of a bundle, a recommendation and a card of an unknown product.
TEXT_SCORE = ". Bundle Score="
TEXT_LABELS = ("Theme", "Offer", "Confidence", "Expected impact", "Placement")
TEXT_IS_ANCHOR = " (Anchor)"
TEXT_TOGETHER = "Frequently bought together (based on basket affinity) for product_id="
TEXT_POPULAR = "Popular alternatives in the same department (department_id="
TEXT_UNKNOWN = " (not found)"

# The parts of a generated module page, in the order in which they are written.
PAGE_TITLE = "# `%s` Module\n"
PAGE_SYMBOL = "## `%s`\n\n"
PAGE_FILE = "- **File:** `%s` (lines %d-%d)\n"
PAGE_CALLERS = "- **Called by:** %s\n"
PAGE_NO_CALLERS = "(not shown)"
PAGE_CALLEES = "- **Calls:** %s\n\n"
PAGE_NO_CALLEES = "(none)"
PAGE_SUMMARY = "%s\n\n"
PAGE_CODE = "```python\n%s\n```\n\n"
