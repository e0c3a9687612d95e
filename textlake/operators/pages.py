"""Pages -> documents: field extraction, the key gate and link extraction.

The crawl itself (HTTP, follow queue) is not rebuilt; pages arrive as a
table (page_id, url, html) and every step is a per-row expression, so the
work is spread exactly as the page table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions.constants import (CONTENT_SELECTORS, GATE_KEY_SELECTOR, GATE_SLOT_SELECTOR,
                                          LIST_SELECTORS, TITLE_SELECTORS)
from textlake.functions.html import anchor_texts, decoded_sql, hrefs, joined_text, page_paragraphs
from textlake.functions.markup import (any_pattern, nodes_sql, path_pattern, selected_by_sql,
                                       selected_sql, text_nodes)
from textlake.functions.text import normalize_array
from textlake.functions.urls import resolve_href, url_host, url_lang


def page_extract(pages: DataFrame, url: str = "url", html: str = "html",
                 keep: Sequence[str] = ("page_id",), title: Sequence[str] = TITLE_SELECTORS,
                 content: Sequence[str] = CONTENT_SELECTORS, speakers: Sequence[str] = LIST_SELECTORS
                 ) -> DataFrame:
    """One raw document per page: title, content, speakers (lower-cased and
    stripped) and link.  Each field is what its selectors take, selector by
    selector; the page is folded once for all of them."""
    nodes = text_nodes(html, any_pattern([*title, *content, *speakers]))
    folded = pages.select(*keep, F.col(url).alias("link"), nodes.alias("_nodes"))
    return folded.select(
        *keep,
        joined_text(selected_by_sql("_nodes", title)).alias("title"),
        joined_text(selected_by_sql("_nodes", content)).alias("content"),
        normalize_array(F.expr(decoded_sql(selected_by_sql("_nodes", speakers)))).alias("speakers"),
        "link",
    )


def page_anchor_list(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",),
                     speakers: Sequence[str] = LIST_SELECTORS) -> DataFrame:
    """(keep..., pos, speaker): the list field, one row per element."""
    return pages.select(*keep, F.posexplode(normalize_array(anchor_texts(html, speakers)))
                        .alias("pos", "speaker"))


def page_gate_condition(special: Sequence[str], slot: str | Column = GATE_SLOT_SELECTOR, url: str = "url",
                        html: str = "html", key: str | Column = GATE_KEY_SELECTOR) -> Column:
    """Boolean Column: the key in the page URL agrees with the key in its markup.

    For keys in ``special`` the page key is not reliable; such a page passes
    when its slot field has at least one value.  Otherwise the page key must
    be non-empty and contain the URL key.  ``slot`` and ``key`` are selectors
    (the key's texts are joined by a blank) or Columns, an array of values
    and a string.
    """
    url_key = url_lang(url)
    content_key = page_key(html, key)
    slots = F.size(text_nodes(html, path_pattern(slot)) if isinstance(slot, str) else slot)
    return (F.when(url_key.isin(list(special)), slots > 0)
            .otherwise((content_key != "") & (F.instr(content_key, url_key) > 0)))


def page_key(html: str = "html", key: str | Column = GATE_KEY_SELECTOR) -> Column:
    """The key that a page's markup holds, by a selector or as a Column."""
    if isinstance(key, Column):
        return key
    return F.array_join(F.transform(text_nodes(html, path_pattern(key)), lambda n: n["text"]), " ")


def page_gate(pages: DataFrame, special: Sequence[str], slot: str | Column = GATE_SLOT_SELECTOR,
              url: str = "url", html: str = "html", key: str | Column = GATE_KEY_SELECTOR) -> DataFrame:
    """Pages that pass ``page_gate_condition``, with both keys."""
    keep = page_gate_condition(special, slot, url, html, key)
    return (pages.where(keep)
            .select("page_id", F.col(url).alias("url"), url_lang(url).alias("url_key"),
                    page_key(html, key).alias("page_key")))


def page_links(pages: DataFrame, allowed_suffixes: Sequence[str], deny: str = "/file/",
               url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, href, target): links to follow from each page.

    hrefs are resolved against the page URL; a link is kept when it does
    not contain ``deny`` and its host equals or ends in one of
    ``allowed_suffixes`` (the allowed domains).
    """
    links = pages.select("page_id", F.col(url).alias("_base"),
                         F.explode(hrefs(html)).alias("href"))
    target = resolve_href(F.col("href"), F.col("_base"))
    host = url_host(target)
    allowed = None
    for suffix in allowed_suffixes:
        cond = (host == F.lit(suffix)) | host.endswith("." + suffix)
        allowed = cond if allowed is None else (allowed | cond)
    keep = (F.instr(target, deny) == 0) if deny else F.lit(True)
    if allowed is not None:
        keep = keep & allowed
    return links.select("page_id", "href", target.alias("target")).where(keep)


LAYOUT_SCHEMA = ("site_key string, title array<string>, content array<string>, speakers array<string>, "
                 "wanted string")


def layout_rules(spark: SparkSession, layouts: Sequence[tuple[str, Sequence[str], Sequence[str], Sequence[str]]]
                 ) -> DataFrame:
    """Layouts (site key, and the selectors of title, content and speakers) as a
    table of compiled patterns."""
    rows = [(key, *[[path_pattern(s) for s in field] for field in fields], any_pattern([s for field in fields for s in field]))
            for key, *fields in layouts]
    return spark.createDataFrame(rows, LAYOUT_SCHEMA)


def page_extract_by_layout(pages: DataFrame, layouts: DataFrame, site_key,
                           html: str = "html", url: str = "url",
                           keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Extraction whose selectors depend on the site (one layout per site key).

    ``layouts`` (of ``layout_rules``) is joined to the pages on ``site_key`` (a
    Column over the page); no side is hinted, Spark broadcasts the rules when
    their size allows it.  Pages whose key has no layout keep NULL fields.
    """
    keyed = pages.select(*keep, F.col(url).alias("link"), site_key.alias("site_key"), F.col(html).alias("_html"))
    folded = keyed.join(layouts, on="site_key", how="left").withColumn("_nodes", F.expr(nodes_sql("_html", "wanted")))

    def texts(field: str) -> str:
        return f"flatten(transform({field}, _rule -> {selected_sql('_nodes', '_rule')}))"

    return folded.select(*keep, "link", "site_key", joined_text(texts("title")).alias("title"),
                         joined_text(texts("content")).alias("content"),
                         normalize_array(F.expr(decoded_sql(texts("speakers")))).alias("speakers"))


def direct_paragraph_text(pages: DataFrame, html: str = "html",
                          keep: Sequence[str] = ("page_id",), scope_tag: str = "article"
                          ) -> DataFrame:
    """Paragraph text made of *direct* text nodes only (text of a <p> that is
    not inside a nested element), the way a CSS ``article p::text`` selector
    reads a page."""
    return pages.select(*keep, page_paragraphs(html, [f"{scope_tag} p::text"]).alias("content"))
