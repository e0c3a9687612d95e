"""Page fields as Column functions over the text nodes of a page.

Which nodes make a field is said by selectors (``textlake.functions.markup``);
the defaults are those of the original pages.  Links are read off the tags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.constants import CONTENT_SELECTORS, LIST_SELECTORS, TITLE_SELECTORS
from textlake.functions.markup import (BLANKS_PATTERN, QUOTES_PATTERN, any_pattern, nodes_sql, noise_free_sql,
                                       selected_by_sql)
from textlake.functions.references import decode_sql
from textlake.functions.text import ColumnOrName, _col, sql_let, sql_literal

HREF_PATTERN = (r"(?is)<(?:a|area)\s(?:[^>]*?\s)?href\s*=\s*"
                r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
PAGE_LANG_PATTERN = r"(?is)<html\s(?:[^>]*?\s)?lang\s*=\s*[\"']?([^\"'\s>]*)"


def joined_sql(texts: str) -> str:
    return decode_sql(f"trim(regexp_replace(array_join({texts}, ' '), {sql_literal(BLANKS_PATTERN)}, ' '))")


def joined_text(texts: str) -> Column:
    """Texts (a column of arrays, or SQL) joined by a blank, blanks squeezed, references decoded."""
    return F.expr(joined_sql(texts))


def decoded_sql(texts: str) -> str:
    """SQL text of an array of texts, references decoded."""
    return f"transform({texts}, _t -> {decode_sql('_t')})"


def _taken(html: str, selectors: Sequence[str]) -> str:
    return selected_by_sql(sql_let(html, "_html", nodes_sql("_html", sql_literal(any_pattern(selectors)))), selectors)


def page_title(html: str, selectors: Sequence[str] = TITLE_SELECTORS) -> Column:
    """Texts of the title elements of a page (a column's name or SQL), joined by a blank."""
    return joined_text(_taken(html, selectors))


def page_paragraphs(html: str, selectors: Sequence[str] = CONTENT_SELECTORS) -> Column:
    """Texts of the paragraphs of every scope, joined by a blank.

    ``article p::text`` takes a paragraph's own text nodes, ``article p ::text`` also
    those of the elements in it.
    """
    return joined_text(_taken(html, selectors))


def anchor_texts(html: str, selectors: Sequence[str] = LIST_SELECTORS) -> Column:
    """The list field, one element for each text node, references decoded."""
    return F.expr(decoded_sql(_taken(html, selectors)))


def hrefs(html: str) -> Column:
    """Targets of <a> and <area>, any case and quoting, decoded, each once."""
    found = f"regexp_extract_all({noise_free_sql(html)}, {sql_literal(HREF_PATTERN)}, 1)"
    target = decode_sql(f"regexp_replace(_h, {sql_literal(QUOTES_PATTERN)}, '')")
    return F.expr(f"array_distinct(transform({found}, _h -> trim({target})))")


def page_lang(html: ColumnOrName) -> Column:
    return F.regexp_extract(_col(html), PAGE_LANG_PATTERN, 1)
