"""Pages as streams of tags and text nodes, and selectors over them.

A page is cut into its tags and the text between them.  One fold over that
array keeps the path of open elements, so nesting to any depth is followed:
an end tag closes the last open element of its name and all inside it, one
without such an element is ignored, void and self-closed elements never open,
and a block element ends an open paragraph.  Each text node leaves the fold
with the path of the elements it lies in.

A path is written ``/tag#id#.class.class.`` for each element, from the
outermost.  A selector (tag, ``.class``, ``#id``, ``*``, descendant by a blank,
child by ``>``, then ``::text`` for an element's own text nodes or `` ::text`` for
all below it) is compiled to a regular expression over paths, in the common
subset of Java and RE2.  Everything runs on one row at a time inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import sql_let, sql_literal

#: What never reaches the stream: scripts, styles and comments may hold fake markup.
NOISE_PATTERN = (r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
                 r"|<!--.*?-->")
#: A tag (quoted values may hold ``>``), a tag with an unpaired quote, a text, a lone ``<``.
TOKEN_PATTERN = (r"<[a-zA-Z/!?][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>|<[a-zA-Z/!?][^>]*>|[^<]+|<")
NAME_PATTERN = r"^</?([a-zA-Z][^ \t\r\n\f/>]*)"
SELF_CLOSED_PATTERN = r"/>$"
QUOTES_PATTERN = r"^[\"']|[\"']$"
BLANKS_PATTERN = r"[ \t\r\n\f]+"

# FIXED VALUES: elements of HTML that have no content, and those whose start ends an open paragraph.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
ENDS_PARAGRAPH = ["p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "footer",
                  "header", "pre", "blockquote", "form", "hr"]

#: Signs that part a path's elements, and what stands for them inside ids and classes.
PARTING, STAND_INS = "/#.", "\x01\x02\x03"


def attribute_pattern(name: str) -> str:
    """Group 1: the value (quotes included) of an attribute of a start tag; other attributes' values are passed over whole."""
    blank, value = r"[ \t\r\n\f]", r"(?:\"[^\"]*\"|'[^']*'|[^ \t\r\n\f\"'>]+)"
    other = rf"{blank}+[^ \t\r\n\f=>\"']+(?:{blank}*={blank}*{value})?"
    return rf"(?i)^<[a-z][^ \t\r\n\f/>]*(?:{other})*?{blank}+{name}{blank}*={blank}*({value})"


def noise_free_sql(html: str) -> str:
    """SQL text of a page without scripts, styles and comments."""
    return f"regexp_replace({html}, {sql_literal(NOISE_PATTERN)}, '')"


# --- selectors ------------------------------------------------------------------

_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


def _element(compound: str) -> str:
    """The pattern of one element of a path."""
    found = _COMPOUND.fullmatch(compound)
    if not compound or found is None:
        raise ValueError(f"not a selector: {compound!r}")
    tag, marks = found[1], re.findall(r"[.#][\w-]+", found[2])
    ids, classes = ([m[1:] for m in marks if m[0] == kind] for kind in "#.")
    if len(ids) > 1:
        raise ValueError(f"more than one id: {compound!r}")
    some = r"(?:[^/.]+\.)*"
    orders = ["".join(f"{some}{re.escape(c)}\\." for c in order) + some for order in permutations(dict.fromkeys(classes))]
    own_classes = orders[0] if len(orders) == 1 else f"(?:{'|'.join(orders)})"
    return f"/{re.escape(tag.lower()) if tag and tag != '*' else '[^/#]+'}#{re.escape(ids[0]) if ids else '[^/#]*'}#\\.{own_classes}"


def path_pattern(selector: str) -> str:
    """A selector of text nodes as a regular expression over their paths."""
    found = re.fullmatch(r"\s*(.*?)(\s*)::text\s*", selector, re.S)
    if found is None:
        raise ValueError(f"a selector of text ends in ::text: {selector!r}")
    compounds = re.sub(r"\s*>\s*", " > ", found[1]).split()
    if not compounds or compounds[0] == ">" or compounds[-1] == ">":
        raise ValueError(f"not a selector: {selector!r}")
    out, gap = "", ""
    for part in compounds:
        if part == ">":
            gap = ""
            continue
        out += gap + _element(part)
        gap = "(?:/[^/]*)*"
    return out + (gap if found[2] else "") + r"\z"


def any_pattern(selectors: Sequence[str]) -> str:
    """One pattern for the paths that any of the selectors takes."""
    return "|".join(path_pattern(s) for s in selectors) or r"[^\x00-\x{10FFFF}]"


# --- the stream -------------------------------------------------------------------

def _safe(e: str) -> str:
    return f"translate({e}, {sql_literal(PARTING)}, {sql_literal(STAND_INS)})"


def _attribute(tag: str, name: str) -> str:
    value = f"regexp_extract({tag}, {sql_literal(attribute_pattern(name))}, 1)"
    return _safe(f"regexp_replace({value}, {sql_literal(QUOTES_PATTERN)}, '')")


def tokens_sql(html: str) -> str:
    """SQL text of a page's tags and texts in order: (kind, tag, code, text), where kind is
    text, open, empty (opens nothing), close or none."""
    void = ", ".join(map(sql_literal, VOID))
    kind = ("CASE WHEN _tag = '' THEN CASE WHEN _token RLIKE '^<.' THEN 'none' ELSE 'text' END WHEN startswith(_token, '</') THEN 'close' "
            f"WHEN _tag IN ({void}) OR _token RLIKE {sql_literal(SELF_CLOSED_PATTERN)} THEN 'empty' ELSE 'open' END")
    classes = f"replace(trim(regexp_replace({_attribute('_token', 'class')}, {sql_literal(BLANKS_PATTERN)}, ' ')), ' ', '.')"
    marks = f"concat({_attribute('_token', 'id')}, '#.', {sql_let(classes, '_classes', "if(_classes = '', '', concat(_classes, '.'))")})"
    # a tag of its name alone has no attributes to look for
    code = f"concat('/', _tag, '#', CASE WHEN length(_token) = length(_tag) + 2 THEN '#.' ELSE {marks} END)"
    described = sql_let(kind, "_kind", "named_struct('kind', _kind, 'tag', _tag, 'code', "
                        f"CASE WHEN _kind = 'open' THEN {code} ELSE '' END, 'text', _token)")
    name = _safe(f"lower(regexp_extract(_token, {sql_literal(NAME_PATTERN)}, 1))")
    found = f"regexp_extract_all({noise_free_sql(html)}, {sql_literal(TOKEN_PATTERN)}, 0)"
    return f"transform({found}, _token -> {sql_let(name, '_tag', described)})"


def _cut(path: str, mark: str) -> str:
    """SQL text of ``path`` before the last element that begins with ``mark``; all of it if none does."""
    return (f"CASE WHEN instr({path}, {mark}) = 0 THEN {path} ELSE "
            f"substr({path}, 1, length({path}) - length(substring_index({path}, {mark}, -1)) - length({mark})) END")


def nodes_sql(html: str, wanted: str | None = None) -> str:
    """SQL text of ``text_nodes``; ``wanted`` is SQL too."""
    ends = f"_x.tag IN ({', '.join(map(sql_literal, ENDS_PARAGRAPH))})"
    path = ("CASE _x.kind WHEN 'text' THEN _s.path WHEN 'none' THEN _s.path "
            f"WHEN 'close' THEN {_cut('_s.path', "concat('/', _x.tag, '#')")} "
            f"ELSE concat(CASE WHEN {ends} THEN {_cut('_s.path', "'/p#'")} ELSE _s.path END, _x.code) END")
    keep = "_x.kind = 'text'" + (f" AND _s.path RLIKE {wanted}" if wanted is not None else "")
    nodes = f"CASE WHEN {keep} THEN concat(_s.nodes, array(named_struct('path', _s.path, 'text', _x.text))) ELSE _s.nodes END"
    start = "named_struct('path', '', 'nodes', cast(array() AS array<struct<path:string,text:string>>))"
    return f"aggregate({tokens_sql(html)}, {start}, (_s, _x) -> named_struct('path', {path}, 'nodes', {nodes})).nodes"


def text_nodes(html: str, wanted: str | None = None) -> Column:
    """(path, text) of a page's text nodes in order, references not yet decoded.

    ``html`` is a column's name or an SQL expression.  ``wanted``, a pattern (of
    ``path_pattern`` or ``any_pattern``), keeps only nodes on such paths, so that
    the fold gathers no others.  NULL for NULL pages.
    """
    return F.expr(nodes_sql(html, None if wanted is None else sql_literal(wanted)))


def selected_sql(nodes: str, pattern: str) -> str:
    """SQL text of the texts of the nodes (SQL) whose path a pattern (SQL) matches, in page order."""
    return f"transform(filter({nodes}, _n -> _n.path RLIKE {pattern}), _n -> _n.text)"


def selected_by_sql(nodes: str, selectors: Sequence[str]) -> str:
    """SQL text of the texts that each selector takes, selector by selector."""
    return f"concat({', '.join(selected_sql(nodes, sql_literal(path_pattern(s))) for s in selectors)})"


def selected_by(nodes: str, selectors: Sequence[str]) -> Column:
    """The texts that each selector takes of a column of nodes, selector by selector."""
    return F.expr(selected_by_sql(nodes, selectors))
