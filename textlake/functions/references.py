"""Character references (``&eacute;``, ``&#8217;``, ``&#xe4;``) to text, in one pass.

A text is cut at its ampersands; what follows one is looked up by its leading
name or number.  What no reference begins stays as it is, and what a reference
gave is never read again (``&amp;lt;`` becomes ``&lt;``).

The names are those of the HTML standard as Python's library lists them, read
at run time; those that the standard allows without a semicolon are
recognised without one when no letter or digit follows.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions.text import sql_let, sql_literal

#: The reference at the start of what follows an ampersand.
REFERENCE_PATTERN = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
#: Code points that numbers can't name; those of C1 name what they do in Windows-1252.
REPLACEMENT = "�"


def _c1() -> dict[int, str]:
    out = {}
    for code in range(0x80, 0xA0):
        try:
            out[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            continue
    return out


#: Names (with their semicolon, if any) and the signs they stand for.
NAMED = dict(html5)
#: Numbers that stand for another code point.
RENUMBERED = {0: REPLACEMENT, **_c1()}


def _by_letter() -> str:
    """The names as JSON, by first letter: a lookup passes few of them."""
    letters: dict[str, dict[str, str]] = {}
    for name, sign in NAMED.items():
        letters.setdefault(name[0], {})[name] = sign
    return json.dumps(letters)


def _code_point(number: str) -> str:
    """SQL text of the sign of a code point (a bigint)."""
    renumbered = f"try_element_at(from_json({sql_literal(json.dumps(RENUMBERED))}, 'map<string,string>'), string({number}))"
    return (f"CASE WHEN {number} > 1114111 OR {number} BETWEEN 55296 AND 57343 THEN {sql_literal(REPLACEMENT)} "
            f"ELSE coalesce({renumbered}, decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')) END")


def _number(name: str) -> str:
    """SQL text of the code point that ``#8217;`` or ``#xe4;`` names; very long numbers are beyond all."""
    value = (f"CASE WHEN length(_digits) > 8 THEN 1114112L WHEN _digits = '' THEN 0L "
             f"WHEN lower(substr({name}, 2, 1)) = 'x' THEN bigint(conv(_digits, 16, 10)) ELSE bigint(_digits) END")
    return sql_let(f"regexp_replace({name}, '^#[xX]?0*|;', '')", "_digits", value)


def decode_sql(e: str) -> str:
    """SQL text of ``e`` with its character references replaced."""
    named = (f"try_element_at(try_element_at(from_json({sql_literal(_by_letter())}, 'map<string,map<string,string>>'), "
             "substr(_name, 1, 1)), _name)")
    known = f"CASE WHEN startswith(_name, '#') THEN {sql_let(_number('_name'), '_code', _code_point('_code'))} ELSE {named} END"
    sign = sql_let(f"regexp_extract(_part, {sql_literal(REFERENCE_PATTERN)}, 1)", "_name",
                   f"coalesce(concat({known}, substr(_part, length(_name) + 1)), concat('&', _part))")
    parts = "split(_whole, '&')"
    decoded = f"array_join(concat(slice({parts}, 1, 1), transform(slice({parts}, 2, size({parts})), _part -> {sign})), '')"
    # a text without an ampersand, as most are, is not cut at all
    return sql_let(e, "_whole", f"CASE WHEN instr(_whole, '&') = 0 THEN _whole ELSE {decoded} END")


def decode_references(e: str) -> Column:
    """Text (a column's name or an SQL expression) with its character references
    replaced by what they stand for."""
    return F.expr(decode_sql(e))
