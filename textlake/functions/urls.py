"""URL keys as Column functions (regex forms shared with the SQL oracle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.constants import DEFAULT_URL_KEY, WWW_ALIAS
from textlake.functions.text import ColumnOrName, _col

# Group key of a URL: the digits of the first host label that is all digits
# ("http://2015.site.de/..." -> "2015").
URL_KEY_PATTERN = r"//([0-9]+)\."
# Language segment of a URL path ("https://h.example.com/en/12" -> "en").
URL_LANG_PATTERN = r"^https?://[^/]+/([a-z]+)/"
# Host of an absolute URL.
URL_HOST_PATTERN = r"^https?://([^/:?#]+)"


def url_group_key(c: ColumnOrName, alias: tuple[str, str] = WWW_ALIAS,
                  pattern: str = URL_KEY_PATTERN) -> Column:
    """SQL form: alias the ``www.`` host first, then extract; '' on no match."""
    aliased = F.replace(_col(c), F.lit(alias[0]), F.lit(alias[1]))
    return F.regexp_extract(aliased, pattern, 1)


def url_group_key_default(c: ColumnOrName, default: str = DEFAULT_URL_KEY,
                          pattern: str = URL_KEY_PATTERN) -> Column:
    """Crawler form: extract; ``default`` on no match (no aliasing)."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit("")), F.lit(default))


def url_lang(c: ColumnOrName) -> Column:
    """First path segment of lower-case letters; '' on no match."""
    return F.regexp_extract(_col(c), URL_LANG_PATTERN, 1)


def url_host(c: ColumnOrName) -> Column:
    return F.regexp_extract(_col(c), URL_HOST_PATTERN, 1)


def resolve_href(href: ColumnOrName, base_url: ColumnOrName) -> Column:
    """Absolute URL of an href relative to the page it was found on.

    Absolute hrefs are kept; ``//host/..`` takes the page scheme; ``/path``
    takes the page scheme and host; anything else (fragments, mailto:,
    relative paths) is resolved against the page URL's directory.  Dot
    segments are removed.
    """
    h, base = _col(href), _col(base_url)
    scheme = F.regexp_extract(base, r"^([a-z]+:)", 1)
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    directory = F.regexp_extract(base, r"^([a-z]+://[^?#]*/)", 1)
    target = (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("#") | (h == ""), base)
            .otherwise(F.concat(F.when(directory == "", F.concat(origin, F.lit("/")))
                                .otherwise(directory), h)))
    return remove_dot_segments(target)


URL_ORIGIN_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)"


def remove_dot_segments(url: Column) -> Column:
    """``.`` and ``..`` path segments resolved, as a browser does; the part
    after ``?`` or ``#`` is left alone."""
    origin = F.regexp_extract(url, URL_ORIGIN_PATTERN, 1)
    rest = F.substr(url, F.length(origin) + 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    parts = F.split(path, "/")
    # "/a/b/.." names the folder: a last dot segment leaves an empty one
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: (
        F.when(p == ".", done)
        .when(p == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(p)))))
    fixed = F.concat(origin, F.array_join(kept, "/"), F.substr(rest, F.length(path) + 1))
    return F.when((origin != "") & path.rlike(r"/[.]{1,2}(/|$)"), fixed).otherwise(url)
