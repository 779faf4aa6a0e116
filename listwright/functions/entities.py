"""Character references of HTML, decoded once."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references and their characters: those of HTML 4, and ``apos``.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

_REFERENCE = r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def character(code: Column) -> Column:
    """The character of a code point; null for a surrogate and beyond the last one."""
    units = lambda c: F.lpad(F.hex(c), 4, "0")
    rest = code - 0x10000
    pair = F.concat(units(F.shiftright(rest, 10) + 0xD800), units(rest.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    known = (code < 0xD800) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(known, F.decode(F.unhex(F.when(code < 0x10000, units(code)).otherwise(pair)), "UTF-16BE"))


def decode_entities(text: Column) -> Column:
    """References by name, decimal and hexadecimal number to their characters. What isn't closed by a semicolon, names
    nothing or numbers no character stays; what a reference decodes to isn't decoded again. Null stays null."""
    table = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        digits = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
        found = F.when(name == "", None).when(F.startswith(name, F.lit("#")), character(digits.cast("long"))).otherwise(F.try_element_at(table, name))
        return F.coalesce(F.concat(found, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    whole = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
