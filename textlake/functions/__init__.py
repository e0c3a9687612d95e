"""Column -> Column building blocks (text, URLs, page markup)."""

from textlake.functions.html import anchor_texts, hrefs, page_lang, page_paragraphs, page_title
from textlake.functions.markup import text_nodes
from textlake.functions.references import decode_references
from textlake.functions.text import (clean_string, first_line, glue_phrases, normalize_array,
                                     normalize_text, remove_stopwords, strip_plural, tokens)
from textlake.functions.urls import url_group_key, url_group_key_default, url_host, url_lang

__all__ = [
    "anchor_texts", "clean_string", "decode_references", "first_line", "glue_phrases", "hrefs",
    "normalize_array", "normalize_text", "page_lang", "page_paragraphs", "page_title",
    "remove_stopwords", "strip_plural", "text_nodes", "tokens", "url_group_key", "url_group_key_default",
    "url_host", "url_lang",
]
