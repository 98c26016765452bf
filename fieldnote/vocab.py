"""Word lists, lookup tables, constants and patterns the results depend on.

Everything here is data. It is stated as the results need it and is used by the operators; each list
can be replaced by an argument of the operator that reads it.
"""

from __future__ import annotations

# ---------------------------------------------------------------- sources (fixed values)
SOURCE_METHOD = {
    "reddit": "apify",
    "x": "apify",
    "quora": "apify",
    "gp_help": "headless_render",
    "play": "public_scraper_lib",
    "appstore": "public_feed",
    "youtube": "official_api",
    "stackexchange": "official_api",
    "hackernews": "official_api",
}
COLLECT_METHODS = ["official_api", "public_feed", "public_scraper_lib", "headless_render", "apify"]
DELETED_MARKERS = ["[deleted]", "[removed]", "[deleted by user]", ""]
POST_SEPARATOR = "\n\n"
BOT_AUTHORS = [
    "automoderator", "automod", "botdefense", "remindmebot", "sneakpeekbot",
    "repostsleuthbot", "savevideo", "vredditdownloader", "wikitextbot",
]
SOURCE_KIND = {
    "play": "reviews",
    "appstore": "reviews",
    "reddit": "reddit",
    "gp_help": "community_forums",
    "stackexchange": "community_forums",
    "quora": "community_forums",
    "hackernews": "community_forums",
    "youtube": "other:youtube_comments",
    "x": "other:x_posts",
}
PLATFORM_MAX = {"play": 500, "x": 280}
TRUNCATION_CAPS = [280, 500, 1000, 2000, 4000, 5000, 10000]
TRUNCATION_ENDINGS = ["… (more)", "...more", "Read more"]

# ---------------------------------------------------------------- enumerations (fixed values)
STAGES_OF_WORK = ["collect", "clean", "prefilter", "segment", "code", "validate"]
EXCLUSION_REASONS = [
    "deleted", "too_short", "low_quality", "exact_duplicate", "near_duplicate_same_author",
    "lexicon_rejected", "out_of_window", "no_story", "span_unverified", "coding_failed",
    "model_refusal",
]
BUCKETS = ["core", "adjacent", "irrelevant"]
POPULATIONS = ["core", "adjacent"]
PHOTO_CLASSES = ["sentimental", "utility", "both", "unclear"]
MEDIA_TYPES = ["photo", "screenshot", "document", "video", "mixed"]
OUTCOMES = [
    "found", "found_after_struggle", "substitute_accepted", "abandoned_with_fallback",
    "abandoned_without_fallback", "false_positive", "found_later_by_accident", "not_stated",
]
ACCURACIES = ["certain_correct", "certain_wrong", "range", "relative_only", "inferred"]
PLATFORM_HINTS = ["android", "ios", "desktop", "unknown"]
RUN_STATUSES = ["running", "ok", "failed", "halted_budget"]
FAILURE_OWNER = {
    "0": "library_data", "1": "none", "2": "memory", "3": "strategy", "4": "expression",
    "5": "system", "6": "presentation", "7": "recovery", "8": "persistence", "9": "none",
    "10": "none",
}
SPINE_FIELDS = [
    "photo_class", "media_type", "primary_stage", "outcome", "failure_owner", "metric_node",
    "severity",
]
CROSSTAB_FIELDS = [
    "primary_stage", "failure_owner", "metric_node", "outcome", "media_type", "source",
    "photo_class",
]
CROSSTAB_EXTRA = [("primary_stage", "source"), ("q:3.2", "outcome"), ("q:9.4", "outcome")]
BLOCKS = ["A", "B", "C", "D", "R", "S"]
CORE_BLOCKS = ["A", "B", "C", "D", "R"]

# ---------------------------------------------------------------- thresholds (fixed values)
MIN_CHARS = 20
NEAR_DUPLICATE = 0.85
CROSS_AUTHOR_MIN_WORDS = 25
CHUNK_CHARS = 10_000
SNIPPET_CHARS = 700
MIN_SPAN = 15
REGISTER_ABOVE = 0.85
DEGENERATE = 0.85
KAPPA_OK = 0.60
FLOOR = 30
COMPARABLE = 80
MIN_DIVERGENCE_N = 10
CEILING_USD = 21.00
HALT_MULTIPLE = 1.5
BATCH_DISCOUNT = 0.5
MODEL_RATES = {
    # model: (USD per million input tokens, cached input tokens, output tokens)
    "gpt-5": (1.25, 0.125, 10.00),
    "gpt-5-mini": (0.25, 0.025, 2.00),
    "gpt-5-nano": (0.05, 0.005, 0.40),
}

# ---------------------------------------------------------------- language (fixed values)
HINGLISH_MARKERS = [
    "hai", "hain", "nahi", "nahin", "kya", "aur", "bhi", "yaar", "acha", "accha", "bohot",
    "bahut", "kar", "karo", "karna", "kiya", "mera", "meri", "tera", "apna", "mujhe", "hoga",
    "hota", "gaya", "raha", "rahi", "rahe", "bas", "abhi", "phir", "pehle", "wala", "wali",
    "matlab", "kaise", "kyun", "kyu", "thoda", "zyada", "sahi", "galat", "kabhi", "lekin",
    "magar", "mil", "mili", "dhoondh", "dhoondhe", "purani", "yaad", "ki", "ka", "ke", "me",
    "mein", "toh", "koi", "kuch", "sab", "pata",
]
HINGLISH_WEAK = ["me", "ki", "ka", "ke", "bas", "mil", "kar"]
DEVANAGARI = "[\\u0900-\\u097F]"
OTHER_SCRIPT = (
    "[\\u0980-\\u0DFF\\u0E00-\\u0E7F\\u3040-\\u30FF\\u4E00-\\u9FFF\\u0600-\\u06FF"
    "\\u0400-\\u04FF\\uAC00-\\uD7AF]"
)

# ---------------------------------------------------------------- personal data (fixed patterns)
# In order of application: kind, placeholder, pattern. (?U) gives word and digit classes their
# Unicode meaning.
SCRUB_RULES = [
    ("URL", "[URL]", r"(?iU)\bhttps?://\S+|\bwww\.\S+"),
    ("EMAIL", "[EMAIL]", r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("HANDLE", "[HANDLE]", r"(?U)(?<![\w@/])(?:/?u/[A-Za-z0-9_-]{3,}|@[A-Za-z0-9_.]{2,})"),
    ("PAN", "[ID_NUMBER]", r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("AADHAAR", "[ID_NUMBER]", r"(?U)(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)"),
    ("CARD", "[LONG_NUMBER]", r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"),
]
PHONE_CANDIDATE = r"(?U)(?<![\w+])\+?\d[\d\s().-]{7,20}\d(?!\w)"
PHONE_DIGITS = (10, 15)

# ---------------------------------------------------------------- relevance gate (fixed patterns)
LEXICON = {
    "direct": [
        "can't find photo", "cannot find a picture", "lost photo in google photos",
        "find old photo", "search not working", "search doesn't find", "ask photos",
        "photos search useless", "how to find a photo I don't remember when",
        "find photo without date",
    ],
    "cue_shaped": [
        "photo from years ago", "picture of a receipt", "medicine photo", "screenshot I took",
        "photo someone sent me on whatsapp", "photo of a document", "that photo of",
        "remember taking a photo",
    ],
    "workaround_shaped": [
        "scrolled for hours", "had to scroll", "asked my friend to send again",
        "searched whatsapp instead", "found it by accident",
    ],
    "hinglish_hindi": [
        "photo nahi mil rahi", "purani photo kaise dhoondhe", "google photos me photo search",
    ],
}
STRONG_PHRASE = (
    r"(?i)(can.?t find|cannot find|could ?n.?t find|unable to find|scroll(ed|ing)? "
    r"(through|back|for|down)|what to (type|search)|search(ed|ing)? for|"
    r"search (karu|kiya|kar|karke|karne)|dhoondh|nahi mil|mil nahi|nahin mil)"
)
THING_WORD = (
    r"(?i)\b(photos?|pictures?|pics?|images?|screenshots?|screen ?shots?|selfies?|snaps?|"
    r"videos?|receipts?|documents?|scans?|albums?|gallery|memories|foto|tasveer|tasveerein|"
    r"google photos|ask photos|camera roll|whiteboard|prescription|id card|aadhaar|passport)\b"
    r"|(?i:photograph(ed|ing)?|screenshott?ed|snapped|clicked (a|the) (pic|photo)|"
    r"took (a|the|some) (pic|photo|picture|screenshot))"
)
THING_DEVANAGARI = "(फोटो|फ़ोटो|तस्वीर|पिक्चर|फोटोज|फ़ोटोज़|चित्र|गैलरी|स्क्रीनशॉट)"

# ---------------------------------------------------------------- retrieval (fixed values)
STOP_WORDS = (
    "the a an and or but if of to in on at for with by from is are was were be it this that what "
    "which how why do does did i my me you your they their photo photos picture pictures google "
    "find found search"
).split()
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# ---------------------------------------------------------------- rules (fixed values)
OUTCOME_POINTS = {
    "found": 0, "found_later_by_accident": 0, "not_stated": 0,
    "found_after_struggle": 1, "substitute_accepted": 1,
    "abandoned_with_fallback": 2, "abandoned_without_fallback": 2, "false_positive": 2,
}
SEVERITY_SCALE = {1: (0, 1), 2: (2, 3), 3: (4, 5), 4: (6, 6), 5: (7, 8)}
DATA_WRONG = [
    "date:received_date_not_capture", "date:scan_date", "date:wrong_clock_or_timezone",
    "location:absent", "location:inaccurate", "faces:grouping_off_or_unavailable",
]
# question -> values that do not count as a failure
NOT_A_FAILURE = {
    "5.1": ["parsed_ok"], "5.2": [], "5.3": ["soft_ok"], "5.4": [], "5.6": [], "4.3": [],
}
CUE_FAMILIES = [
    "who", "what", "where", "when", "event", "perceptual", "meaning", "capture", "source",
    "library_position",
]
FORGOTTEN_FAMILY = {
    "date_or_year": "when",
    "exact_place_or_venue_name": "where",
    "album": "library_position",
    "whose_phone_took_it": "who",
    "word_for_the_thing": "what",
    "what_else_in_frame": "what",
    "photo_video_or_screenshot": "what",
    "which_app_or_account": "source",
}
FAILURE_MODE_QUESTIONS = {
    "0": ["0.1", "0.2"], "2": ["2.4"], "3": ["3.2", "3.4"], "4": ["4.3"],
    "5": ["5.6", "5.1", "5.2", "5.3", "5.4"], "6": ["6.4", "3.2"], "7": ["7.2"], "8": ["8.2"],
}
FAILURE_STAGES = ["0", "2", "3", "4", "5", "6", "7", "8"]
STAGE_NODE = {
    "0": "target_retrievable",
    "1": "context",
    "2": "query_captures_usable_cue",
    "3": "enters_gp_retrieval_path",
    "4": "query_captures_usable_cue",
    "5": "query_captures_usable_cue",
    "6": "user_recognises_target",
    "7": "refines_instead_of_quitting",
    "8": "refines_instead_of_quitting",
    "9": "outcome_measure",
    "10": "outcome_measure",
}
NODE_LEVERAGE = {
    "query_captures_usable_cue": 5, "target_ranked_visible": 5, "user_recognises_target": 5,
    "enters_gp_retrieval_path": 4, "found_after_refinement": 3,
    "refines_instead_of_quitting": 3, "target_retrievable": 2,
}
# stage -> (addressable gate, necessity gate, reach), each scored 1-5
CANDIDATE_INPUTS = {
    "0": (2, 1, 3), "2": (3, 5, 3), "3": (4, 3, 4), "5": (5, 5, 4), "6": (4, 3, 3),
}
GATE_MIN = 3
WEIGHTS = {
    "metric_leverage": 30, "severity": 25, "frequency": 20, "evidence_strength": 15, "reach": 10,
}
HEADLINE_CRITERIA = ["metric_leverage", "frequency", "evidence_strength", "reach"]
CRITERION_FIELDS = {
    "frequency": ["primary_stage"], "metric_leverage": ["primary_stage"],
    "evidence_strength": ["source"], "reach": [], "severity": ["severity"],
}
DRAWS = 1000
SPREAD = 10.0

# ---------------------------------------------------------------- shares in words (fixed values)
PROPORTIONS = [
    (0.05, "one in twenty"), (0.10, "one in ten"), (0.125, "one in eight"),
    (1 / 6, "one in six"), (0.20, "one in five"), (0.25, "a quarter"), (1 / 3, "a third"),
    (0.40, "two in five"), (0.50, "half"), (0.60, "three in five"), (2 / 3, "two-thirds"),
    (0.75, "three-quarters"), (0.80, "four in five"), (0.90, "nine in ten"),
]
PROPORTION_TOLERANCE = 0.05
