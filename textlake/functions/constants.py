"""Fixed values.

FIXED VALUES -- these must equal the original analysis for equal results.
They are stated plainly, in their original order, and are only ever read.
"""

# FIXED VALUES: the nine two-word phrases that are glued into one token, in
# the order in which they are applied (order matters: replacements chain).
PHRASES = [
    "big data",
    "open source",
    "machine learning",
    "real time",
    "berlin buzzword",
    "search engine",
    "data store",
    "event sourcing",
    "map reduce",
]

# FIXED VALUES: number of hashed feature buckets (1 << 20) used by the
# hashed TF-IDF pipeline.
NUM_FEATURES = 1 << 20

# FIXED VALUES: top-k sizes of the trend reports.
TOP_WORDS = 50
TOP_TF_IN_GROUP = 20
TOP_RANK_PER_GROUP = 10

# FIXED VALUES: default group key when a URL carries none (crawler form), and
# the host alias rewritten before the SQL form extracts the key.
DEFAULT_URL_KEY = "2016"
WWW_ALIAS = ("//www.", "//2016.")

# FIXED VALUES: title prefixes/suffixes that mark a non-talk entry, written
# as SQL LIKE patterns.
NON_SESSION_TITLES = [
    "lunch%",
    "coffee break%",
    "lightning talk%",
    "% hackathon",
    "% workshop",
    "% barcamp",
]

# FIXED VALUES: selectors of the page fields, in the order in which their
# texts are joined: title, content, list field, and the two fields of the gate.
TITLE_SELECTORS = ["h1.title::text", "h1#page-title::text"]
CONTENT_SELECTORS = ["#main p::text", "article p::text"]
LIST_SELECTORS = [
    ".field-field-speaker a::text",
    ".field-field-indiv-speakers a::text",
    ".field-field-speakers a::text",
    ".field-name-field-session-speaker a::text",
]
GATE_KEY_SELECTOR = ".date-display-single::text"
GATE_SLOT_SELECTOR = ".field-field-session-slot::text"

# The stopword file of the original is not shipped.  This short list is the
# default; every operator takes the list as a parameter.
DEFAULT_STOPWORDS = ["the", "a", "of", "is", "and", "to", "this", "on", "it", "at"]
