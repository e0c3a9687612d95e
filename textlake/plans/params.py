"""Parameters the registered fixture queries use (shared by queries and oracles).

The driver tables stand in for the original corpus: ``documents.lang`` (and
``source``) play the role of the year, ``doc_id`` the link, the first text
line the title.  Terms, phrases and patterns are chosen so that they occur
in the fixture texts and actually change rows.
"""

from textlake.functions.constants import DEFAULT_STOPWORDS, NON_SESSION_TITLES, PHRASES

GROUP = "lang"
SECOND_GROUP = "source"

STOPWORDS = list(DEFAULT_STOPWORDS)
# The fixed phrases never occur in the fixture prose; four pairs that do
# occur are appended so that gluing (and its chaining) changes rows.
FIXTURE_PHRASES = list(PHRASES) + ["de la", "die der", "und der", "que de"]

TIMELINE_TERMS = ["with", "und", "que", "der", "tion", "from"]
CAMP_FIRST = ["que", "les", "des"]
CAMP_SECOND = ["der", "die", "und"]
CAMP_FIRST_LABEL = "que+les+des"
CAMP_SECOND_LABEL = "der+die+und"

# ``source`` stands in for the link in the session filter.
SESSION_LINK = "source"
SESSION_INCLUDE = ["src1%", "%5"]
SESSION_EXCLUDE = list(NON_SESSION_TITLES) + ["the %", "% de"]
STATS_LINK_INCLUDE = ["%1%", "%/content%", "%/session%"]

GROUP_VALUE = "de"
TOP_TF_GROUP_VALUE = "en"
DOCUMENT_KEY_VALUE = 7

PREVIEW_ROWS = 10

# Terms looked up in the vectors: common ones, one of few documents, one of none.
PRESENCE_TERMS = ["with", "und", "que", "license", "notaterm"]
# Of so many documents' lines one is cut short and one has a stray sign before it.
BROKEN_EVERY = 10

# Page gate: keys whose page key is unreliable, and the slot field that
# must be present instead ("has a closing html tag").
GATE_SPECIAL = ["de", "es"]
GATE_SLOT_PATTERN = r"(</html>)"
# The page key is the title, which holds the URL key (a language) on some pages.
GATE_KEY = "h1::text"
# Digits that some of the URLs have.
URL_DIGITS_PATTERN = r"[?&]page=([0-9]+)"
# The fixture pages have plain headings and no speaker fields: navigation and ad blocks stand in.
TITLE = ["h1 ::text"]
CONTENT = ["#main p ::text", "article p ::text"]
SPEAKERS = ["nav a::text", ".ad a::text"]

LINK_ALLOWED_DOMAINS = ["example.com", "example.org"]
LINK_DENY = "/de"  # occurs in the fixture pages; the library's default is "/file/"

AUDIT_BUCKETS = 1 << 20

ROUND = 6

# Per-site layouts for page_extract_by_layout, keyed by the URL language:
# (site_key, selectors of title, content and list field).
PAGE_LAYOUTS = [
    ("en", ["h1 ::text"], ["article p ::text"], ["nav a::text"]),
    ("de", ["head > title::text"], ["body p ::text"], ["ul > li > a::text", ".ad ::text"]),
    ("fr", ["article > h1::text"], ["body p::text", "footer::text"], ["nav li a::text"]),
]

# Session filter on page links (hosts on .com / .org) for page_corpus_timeline.
PAGE_SESSION_INCLUDE = ["%.com/%", "%.org/%"]
