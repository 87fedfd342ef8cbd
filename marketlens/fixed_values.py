"""Word lists, markers, patterns and column names.

Everything here is data that results depend on, stated as plain text. Operators
take these as default arguments, so a caller can pass their own.
"""

from __future__ import annotations

# Words left out of the frequent-word and word-pair counts (133 words).
STOPWORDS: tuple[str, ...] = tuple(
    """
    a about after all almost also am an and any are as at be because been before
    best better but by can case cases charge charger chargers charging clear could
    daily design did do does dont easy even every everything feel feels few for
    from get good great had has have help highly holds how i if in into is it its
    ive just keep like lot magsafe make makes me my nice not now of on one only or
    other out over perfect phone pretty product protect protection really screen
    secure seems show shows simple since slim small so solid some still strong
    style than that the their them there these they this those through to too use
    used using very want was well while with without work works would you your
    """.split()
)

# Theme label -> keywords; a review carries a label if any keyword occurs in it.
THEME_LEXICON: dict[str, tuple[str, ...]] = {
    "magnet_strength": ("magnet", "magsafe", "magnetic", "charger", "wallet", "car mount"),
    "yellowing_material": (
        "yellow", "yellowing", "clear back", "cloudy", "discolor", "material",
    ),
    "drop_protection": (
        "drop", "shockproof", "protect", "protection", "corner", "bumper",
        "raised edge", "raised edges", "camera lip",
    ),
    "fit_and_grip": ("slim", "bulk", "bulky", "grip", "hold", "pocket", "slippery"),
    "buttons_cutouts": (
        "button", "buttons", "cutout", "cutouts", "port", "ports", "mute",
        "camera control",
    ),
    "camera_screen": ("camera", "lens", "screen", "edge", "edges", "lip"),
}

# Characters that suggest UTF-8 text was read as a one-byte encoding.
DAMAGE_HINTS = "âÃð™œ€ÙØ"

# Characters that mark a text as still unreadable after repair.
GARBLED_MARKERS = "ã�ÙØÃâð"

# Replacements for damage that re-decoding cannot undo, applied from first to last.
# The two-character quote rule comes before the ellipsis rule, so the ellipsis rule
# never finds its text; results depend on that order.
DAMAGE_REPLACEMENTS: tuple[tuple[str, str], ...] = (
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\x9d", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("â€", '"'),
    ("â€¦", "..."),
    ("Â", ""),
    ("ï¸�", ""),
    ("â˜º", ""),
)

# Typographic quotes made plain (the left single quote is not among them).
PLAIN_QUOTES: dict[str, str] = {"’": "'", "“": '"', "”": '"'}

EMPTY_REVIEW = "empty_review_text"
UNREADABLE_REVIEW = "garbled_or_non_english"

LETTER_SHARE_THRESHOLD = 0.75
POSITIVE_FROM = 4.0
NEGATIVE_UP_TO = 2.0

# Product tables.
REQUIRED_PRODUCT_COLUMNS: tuple[str, ...] = ("Title", "Price", "Rating", "Reviews", "Brand")
MODEL_PATTERN = r"iphone\s*17"

# Item pages.
ID_LENGTH = 10
ID_PATTERN = r"/dp/([A-Z0-9]{10})"
ITEM_LINK_MARKS: tuple[str, ...] = ("/dp/", "/gp/product/")
MIN_ATTRIBUTE_IDS = 10
MAX_IDS_PER_PAGE = 30
DETAIL_URL_PREFIX = "https://www.amazon.com/dp/"
BLOCK_PHRASES: tuple[str, ...] = ("captcha", "type the characters")
MISSING_TEXT = "N/A"
STATUS_OK = "Success"
STATUS_PARSE_ERROR = "Parse Error"
STATUS_NOT_FETCHED = "Failed to Fetch Detail"
RANK_LABEL = "Best Sellers Rank"
BRAND_PREFIX = "Brand: "

# Columns of the review table and of the cleaned review table.
REVIEW_COLUMNS: tuple[str, ...] = (
    "ASIN", "review_id", "review_page", "review_title", "review_rating_text",
    "review_date", "review_text", "helpful_text", "is_verified_purchase",
)
CLEAN_REVIEW_COLUMNS: tuple[str, ...] = (
    "ASIN", "review_id", "review_page", "review_title", "review_rating_text",
    "review_rating_value", "review_date", "review_text", "review_char_length",
    "review_word_count", "helpful_text", "helpful_count", "is_verified_purchase",
)
STATUS_COLUMNS: tuple[str, ...] = ("is_captcha", "status_trace", "review_count")
KEYWORD_COLUMNS: tuple[str, ...] = (
    "Keyword", "Category", "Intent", "Priority", "Recommended Placement", "Notes",
)
