"""Text columns: trimming, HTML to text, search form."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a character class body (with and without the newline).
_WIDE = "\\x85\\xA0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = "\\t-\\r " + _WIDE
_ASCII_WHITE = "\t\n\x0b\f\r "
_WHITE_IN_LINE = "\\t\\x0B\\f\\r " + _WIDE

# A tag becomes OPEN + its name, if it moves a line, + CLOSE, so that text nodes
# stay apart from each other until the white space between tags is settled.
_OPEN, _CLOSE = "\u0003", "\u0004"

_REST = r"""(?:[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*|[^>]*)>"""
# the "<" stands before the alternatives: at any other character one test fails, not seven
_TAG = (r"(?is)<(?:!--.*?(?:-->|\z)"
        r"|script(?=[\s/>])" + _REST + r".*?(?:</script[^>]*>|\z)"
        r"|style(?=[\s/>])" + _REST + r".*?(?:</style[^>]*>|\z)"
        r"|(/?(?:li|br|p|div|ul|ol|h[1-6]))(?=[\s/>])" + _REST
        + r"|/?[a-z]" + _REST
        + r"|[!?][^>]*>|/[^a-z>][^>]*>)")
_ITEM = f"(?i){_OPEN}li{_CLOSE}"
_LINE = f"(?i){_OPEN}(?:br|/?(?:p|div|h[1-6])|ul|ol){_CLOSE}"
_INLINE = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def trim_white(col: Column) -> Column:
    """Trim every kind of Unicode white space (``trim`` drops only U+0020)."""
    wide = F.regexp_replace(col, f"^[{WHITE}]+|[{WHITE}]+\\z", "")
    return F.when(_is_ascii(col), F.btrim(col, F.lit(_ASCII_WHITE))).otherwise(wide)


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _from_codepoint(code: Column) -> Column:
    """One character from its number; surrogates and overflow give U+FFFD."""
    wide = F.lpad(F.hex(code), 8, "0")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(wide), "UTF-32")).otherwise(F.lit("\ufffd"))


def _entity_text(name: Column, table: Column) -> Column:
    number = F.when(
        F.lower(F.substring(name, 1, 2)) == "#x",
        F.conv(F.substring(name, 3, 10), 16, 10).try_cast("long"),
    ).otherwise(F.substring(name, 2, 10).try_cast("long"))
    return F.when(F.startswith(name, F.lit("#")), _from_codepoint(number)).otherwise(
        F.coalesce(F.try_element_at(table, name), F.concat(F.lit("&"), name, F.lit(";"))))


def decode_entities(col: Column) -> Column:
    """Decode character references in one pass, so ``&amp;lt;`` gives ``&lt;``."""
    # the most frequent names first: map lookup is a linear scan
    common = ["amp", "nbsp", "lt", "gt", "quot", "copy", "middot"]
    names = common + [n for n in name2codepoint if n not in common]
    # one literal, split into a map when the plan is made
    table = F.str_to_map(F.lit("\u0002".join([*(f"{n}\u0001{chr(name2codepoint[n])}" for n in names), "apos\u0001'"])),
                         F.lit("\u0002"), F.lit("\u0001"))
    decoded = F.zip_with(
        F.split(col, _ENTITY, -1), F.regexp_extract_all(col, F.lit(_ENTITY), F.lit(1)),
        lambda piece, name: F.concat(
            piece, F.when(name.isNull(), F.lit("")).otherwise(_entity_text(name, table))))
    # most texts refer to "&" alone, if to anything
    others = F.contains(F.replace(col, F.lit("&amp;"), F.lit("")), F.lit("&"))
    return (F.when(~F.contains(col, F.lit("&")), col).when(others, F.array_join(decoded, ""))
            .otherwise(F.replace(col, F.lit("&amp;"), F.lit("&"))))


def _settle_nodes(s: Column) -> Column:
    """Drop text nodes that are only white space."""
    plain = F.replace(s, F.lit(f"{_CLOSE} {_OPEN}"), F.lit(_CLOSE + _OPEN))
    wide = F.regexp_replace(s, f"{_CLOSE}[{WHITE}]+{_OPEN}", _CLOSE + _OPEN)
    return F.when(_is_ascii(s), plain).otherwise(wide)


def _settle_lines(s: Column) -> Column:
    """Collapse white space per line and keep at most one blank line."""
    plain = F.regexp_replace(s, "[\\t\\x0B\\f\\r ]{2,}|[\\t\\x0B\\f\\r]", " ")
    wide = F.regexp_replace(s, f"[{_WHITE_IN_LINE}]+", " ")
    s = F.when(_is_ascii(s), plain).otherwise(wide)
    s = F.regexp_replace(F.regexp_replace(s, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.btrim(s, F.lit(" \n"))


def _tags_to_lines(s: Column) -> Column:
    s = F.regexp_replace(s, _ITEM, "\n- ")
    s = F.regexp_replace(s, _LINE, "\n")
    return F.regexp_replace(s, _INLINE, "")


def html_to_text(html: Column) -> Column:
    """Readable text of an HTML fragment.

    Items become ``- `` bullets, paragraphs and headings are set apart, script
    and style content vanishes, words split by inline tags are rejoined.
    """
    s = F.coalesce(html, F.lit(""))
    for space in ("&nbsp;", "&#160;", "&#xa0;", "&#xA0;", "\u00a0"):
        s = F.replace(s, F.lit(space), F.lit(" "))
    for space in _ASCII_WHITE[:-1]:
        s = F.replace(s, F.lit(space), F.lit(" "))
    s = bind(s, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    s = F.regexp_replace(s, _TAG, f"{_OPEN}$1{_CLOSE}")
    s = bind(s, lambda x: _settle_nodes(x))
    s = bind(s, lambda x: decode_entities(x))
    return bind(_tags_to_lines(s), lambda x: _settle_lines(x))


def search_form(col: Column) -> Column:
    """Lower-cased tokens joined and padded by single blanks.

    A term or a phrase is then a plain ``contains(' term ')``. Tokens are runs
    of letters and digits of any script.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(
        F.lower(F.coalesce(col, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))


def search_text(title: Column, stack: Column, description: Column) -> Column:
    """Title, tags and description in search form, in that order."""
    return search_form(F.concat_ws(" ", title, F.array_join(stack, " "), description))
