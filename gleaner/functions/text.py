"""Text helpers as Columns."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The named entities of HTML 4, from Python's own table, and the one that XML adds.
NAMED_ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and build on it, so that expressions do not grow by repetition."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(blank_if_null(c), F.lit(WHITESPACE))


def mining_text(title: Column, company: Column, raw: Column) -> Column:
    """The text skills are looked for in."""
    return F.concat_ws(" ", blank_if_null(title), blank_if_null(company), blank_if_null(raw))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (``next.js`` -> ``Next.Js``)."""

    def cased(chars: Column) -> Column:
        def letter(ch: Column, i: Column) -> Column:
            follows = (i > 0) & F.rlike(F.get(chars, i - 1), F.lit(r"^\p{L}"))
            return F.when(follows, F.lower(ch)).otherwise(F.upper(ch))

        return F.array_join(F.transform(chars, letter), "")

    return let(F.split(c, ""), cased)


def label_case(c: Column) -> Column:
    """Display form of a category name."""
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def unescape_entities(c: Column) -> Column:
    """Resolve numeric and named entities, each once; what is no entity stays as it is."""
    names = F.map_from_arrays(F.lit(list(NAMED_ENTITIES)), F.lit(list(NAMED_ENTITIES.values())))

    def resolve(piece: Column, i: Column) -> Column:
        dec = F.regexp_extract(piece, r"^#0*([0-9]{1,7});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1)
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(dec != "", F.hex(dec.cast("long"))).when(hexa != "", hexa)
        valid = F.conv(code, 16, 10).cast("long").between(1, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).when(name != "", F.try_element_at(names, name))

        def placed(found: Column) -> Column:
            rest = F.regexp_replace(piece, r"^[^;]*;", "")
            return F.when(found.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(found, rest))

        return F.when(i == 0, piece).otherwise(let(char, placed))

    def of_text(text: Column) -> Column:
        resolved = F.array_join(F.transform(F.split(text, "&"), resolve), "")
        return F.when(F.contains(text, F.lit("&")), resolved).otherwise(text)

    return let(c, of_text)


def markup_text(c: Column) -> Column:
    """Text of a piece of markup: comments and tags out, each text run trimmed, joined tight."""
    bare = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"\s*<[^>]*>\s*", "")
    return strip(unescape_entities(strip(bare)))


def drop_scripts(c: Column) -> Column:
    """Remove script and style elements, whose text may hold tags."""
    return F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")


def _rounded(x: Column, digits: int, bits: int) -> Column:
    # Round the exact binary value of x, ties to even. The fraction times 2**bits is
    # an exact integer, so the digit and the remainder need no floating point.
    unit, scale = 1 << bits, 10 ** digits
    half = F.lit(unit // 2)

    def of_fraction(scaled: Column) -> Column:
        digit, left = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit(unit - 1))
        up = (left > half) | ((left == half) & (digit.bitwiseAND(F.lit(1)) == 1))
        return (F.floor(x) * F.lit(scale) + digit + F.when(up, 1).otherwise(0)) / F.lit(float(scale))

    return let(((x - F.floor(x)) * F.lit(float(unit))).cast("long") * F.lit(scale), of_fraction)


def percent(part: Column, whole: Column) -> Column:
    """``part`` in ``whole`` as a percentage with one decimal; 0 when ``whole`` is 0."""
    x = (part / F.when(whole != 0, whole) * F.lit(100)).cast("double")
    return F.coalesce(let(x, lambda v: _rounded(v, 1, 57)), F.lit(0.0))


def average(total: Column, n: Column) -> Column:
    """``total / n`` with two decimals; 0 when ``n`` is 0."""

    def rounded(x: Column) -> Column:
        # Below 1/16 a double has bits past 2**-56, and there is room for them.
        return F.when(x < 0.0625, _rounded(x, 2, 60)).otherwise(_rounded(x, 2, 56))

    return F.coalesce(let((total / F.when(n != 0, n)).cast("double"), rounded), F.lit(0.0))
