"""Word lists, aliases, patterns, weights and thresholds that define the results."""

# --- column aliases: internal field -> source names, most canonical first (fixed values) ---
COLUMN_ALIASES = {
    "text": [
        "text", "tweet", "tweet_text", "post", "body", "content", "message", "full_text",
        "post_text", "description", "status",
    ],
    "timestamp": [
        "timestamp", "created_at", "date", "datetime", "posted_at", "time", "published_at",
        "date_posted", "post_date",
    ],
    "platform": ["platform", "source", "network", "site", "service"],
    "hashtags": ["hashtags", "tags", "hashtag", "hash_tags"],
    "likes": [
        "likes", "like_count", "favorite_count", "favourites_count", "upvotes", "hearts",
        "reactions", "num_likes",
    ],
    "comments": [
        "comments", "comment_count", "reply_count", "replies", "num_comments", "num_replies",
    ],
    "shares": [
        "shares", "share_count", "retweet_count", "retweets", "reposts", "num_shares",
        "num_retweets",
    ],
    "author_id": [
        "author_id", "user_id", "username", "user", "screen_name", "user_screen_name", "author",
        "handle", "poster_id",
    ],
    "external_id": [
        "external_id", "id", "post_id", "tweet_id", "status_id", "message_id", "record_id",
    ],
}
REQUIRED_FIELDS = ("text", "timestamp")
OPTIONAL_FIELDS = ("hashtags", "likes", "comments", "shares", "author_id", "external_id")
ENGAGEMENT_FIELDS = ("likes", "comments", "shares")
MIN_TEXT_LENGTH = 3
MAX_ROW_ISSUES = 200
MAX_INT = 2147483647

# --- character classes and patterns (fixed values; valid in Java and RE2) ---
# White space and word characters spelled out, so that every engine agrees on them.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_IN_CLASS = SPACE[1:-1]
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())  # the same, as a list
WORD_IN_CLASS = r"\p{L}\p{N}_"
WORD = f"[{WORD_IN_CLASS}]"
NOT_WORD = f"[^{WORD_IN_CLASS}]"
MENTION_BODY = r"[a-zA-Z0-9_]{1,50}"
HASHTAG_BODY = r"[a-zA-Z0-9_]+"
REPEATED_PUNCTUATION = ("!", "?", ".", ",", ";")
URL_START = r"\b(?:https?://|www\d{0,3}[.]|[a-z0-9.\-]+[.][a-z]{2,4}/)"
URL_CHAR = rf"[^{SPACE_IN_CLASS}()<>]"
URL_LAST_CHAR = rf"""[^{SPACE_IN_CLASS}`!()\[\]{{}};:'".,<>?«»“”‘’]"""
URL_PARENS = rf"\((?:{URL_CHAR}+|\({URL_CHAR}+\))\)"
IMPORT_URL = r"""(?i)https?://[^""" + SPACE_IN_CLASS + r"""<>"{}|\\^`\[\]]*"""
PREPROCESSING_VERSION = "1.0.0"

# --- English stop words: closed-class words (fixed values) ---
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but",
    "by", "can", "could", "did", "do", "does", "doing", "don", "down", "during", "each", "few",
    "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "itself", "just", "ll", "me", "more", "most", "my", "myself", "no", "nor", "not", "now",
    "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over",
    "own", "re", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the",
    "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those",
    "through", "to", "too", "under", "until", "up", "ve", "very", "was", "we", "were", "what",
    "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you",
    "your", "yours", "yourself", "yourselves",
)

# --- entity rules (fixed values) ---
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "PRODUCT", "EVENT", "NORP")
GENERIC_ENTITIES = (
    "new", "record", "investors", "scientists", "fans", "countries", "experts", "highlights",
    "how", "breakthrough", "researchers", "debate", "renewable", "today", "tomorrow",
    "yesterday", "ai", "crypto", "climate", "health", "sports",
)

# --- sentiment (fixed values); the order also settles ties ---
SENTIMENTS = ("positive", "neutral", "negative")
EVALUATION_LABELS = ("negative", "neutral", "positive")

# --- trend model (fixed values) ---
CLASSIFICATIONS = ("emerging", "rising", "stable", "declining")
MAX_BUCKETS = 20000
ACTIVITY_LENGTH = 21

# --- topics (fixed values) ---
OUTLIER_NAME = "Unclassified (Outliers)"
EMBEDDING_SIZE = 384
MERGE_SIMILARITY = 0.90
TOPIC_FAMILIES = [
    # (words that select the family, words that refine it, refined name, plain name)
    (
        ("outbreak", "disease", "health", "vaccine", "hospital", "pandemic"),
        ("outbreak", "crisis", "pandemic"),
        "Public Health Crisis",
        "Public Health",
    ),
    (("renewable", "solar", "wind", "energy"), (), None, "Renewable Energy"),
    (("climate", "emissions", "climatechange", "warming"), (), None, "Climate Change"),
    (
        ("artificialintelligence", "machinelearning", "neural", "transformer", "automation"),
        (),
        None,
        "AI Model Development",
    ),
    (
        ("bitcoin", "ethereum", "crypto", "blockchain", "cryptocurrency"),
        ("regulation", "regulatory", "sec"),
        "Crypto Regulation",
        "Crypto Markets",
    ),
    (
        ("nba", "tournament", "football", "olympics", "sports", "championship"),
        (),
        None,
        "Sports Competition",
    ),
]

# --- weights without engagement and without other weights (fixed values) ---
EQUAL_SHARES = (0.333, 0.333, 0.334)  # volume, velocity, burst

# --- sentences of a trend's explanation (fixed values) ---
VOLUME_SENTENCE = ("Post volume ", " by ", "% compared to the previous period")
ENGAGEMENT_SENTENCE = ("engagement ", " by ", "%")
BURST_SENTENCE = ("activity is ", " standard deviations ", " the historical baseline")
VOLUME_VERBS = ("increased", "decreased")
ENGAGEMENT_VERBS = ("grew", "dropped")
BURST_SIDES = ("above", "below")
PACE_SENTENCES = ("growth is accelerating", "growth is decelerating")
USUAL_SENTENCE = "Activity levels and engagement remain consistent with historical norms."
FEW_POSTS_SENTENCE = ("Stable — insufficient current volume (", " < ", "). ")

# --- details of row issues (fixed values) ---
EMPTY_TEXT_DETAIL = "Text field is empty"
SHORT_TEXT_DETAIL = ("Text too short (", " chars, min ", ")")
EMPTY_TIME_DETAIL = "Timestamp is empty"
BAD_TIME_DETAIL = ("Cannot parse timestamp: '", "'")
DUPLICATE_DETAIL = "Repeated text; retained and flagged"
