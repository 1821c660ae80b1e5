"""HTML5 character references decoded by SQL functions (B2).

The text is split at ``&``: a reference ends before the next ampersand and
decoded text is not read again, so each piece is decoded by itself.  A piece
begins with a decimal or hexadecimal number, with a name closed by a
semicolon, with one of the older names that need none (longest first), or
with no reference at all.  Names and values come from the interpreter's
HTML5 table, packed into two constant maps.
"""

from __future__ import annotations

import html
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTRY, _VALUE = "\x1e", "\x1f"  # occur in no name and no value
REPLACEMENT = "�"
LAST_CODE = 0x10FFFF
DIGITS = 8                       # a number with more digits is beyond every code point
_LAX = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _pack(entries: dict) -> str:
    return _ENTRY.join(f"{k}{_VALUE}{v}" for k, v in entries.items())


@lru_cache(maxsize=None)
def _tables() -> tuple[str, str, str]:
    """Names with a semicolon (those of the older names first: they are the frequent ones), names without, odd code points."""
    closed = {f"{n};": html5[f"{n};"] for n in _LAX} | {n: v for n, v in html5.items() if n.endswith(";")}
    odd = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p + e for p in range(0, LAST_CODE, 0x10000) for e in (0xFFFE, 0xFFFF))]
    # what a number stands for where that is not its own code point: controls, the old Windows range, non-characters;
    # the byte order mark, which a decoder would take for its own
    numbers = {str(c): html.unescape(f"&#{c};") for c in odd if html.unescape(f"&#{c};") != chr(c)} | {str(0xFEFF): "﻿"}
    return _pack(closed), _pack({n: html5[n] for n in _LAX}), _pack(numbers)


def _map(packed: str) -> Column:
    return F.str_to_map(F.lit(packed), F.lit(_ENTRY), F.lit(_VALUE))


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _character(code: Column, odd: Column) -> Column:
    surrogate = (code >= 0xD800) & (code <= 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.element_at(odd, code.cast("string")),
                      F.when(surrogate | (code > LAST_CODE), F.lit(REPLACEMENT)).otherwise(plain))


def _number(piece: Column, pattern: str, base: int, odd: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(piece, pattern, 1), "^0+(?=.)", "")
    code = F.when(F.length(digits) > DIGITS, F.lit(LAST_CODE + 1).cast("long")).otherwise(F.conv(digits, base, 10).cast("long"))
    return F.concat(_bind(code, lambda c: _character(c, odd)), F.regexp_replace(piece, pattern, ""))


def _piece(piece: Column) -> Column:
    """The text that a piece behind an ampersand stands for."""
    closed, lax, odd = map(_map, _tables())
    decimal, hexadecimal, name = "^#([0-9]+);?", "^#[xX]([0-9a-fA-F]+);?", "^[A-Za-z0-9]{1,32};"
    older = "^(" + "|".join(_LAX) + ")"
    plain = F.concat(F.lit("&"), piece)
    named = F.coalesce(
        F.concat(F.element_at(closed, F.regexp_extract(piece, name, 0)), F.regexp_replace(piece, name, "")),
        F.concat(F.element_at(lax, F.regexp_extract(piece, older, 1)), F.regexp_replace(piece, older, "")),
        plain)
    return F.when(piece.rlike(decimal), _number(piece, decimal, 10, odd)).when(
        piece.rlike(hexadecimal), _number(piece, hexadecimal, 16, odd)).when(
        piece.rlike("^[A-Za-z]"), named).otherwise(plain)


def decode_references(text: Column) -> Column:
    """``text`` with its character references decoded once; null stays null."""
    joined = lambda p: F.concat(p.getItem(0), F.array_join(F.transform(F.slice(p, 2, F.size(p)), _piece), ""))
    return _bind(F.split(text, "&", -1), joined)
