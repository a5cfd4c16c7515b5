"""The transform registry of extraction programs, and coercion to declared types, as Column expressions.

A missing value (null) goes through every transform as null. White space is Unicode white space, listed in full, because
the engines' own ``\\s`` is not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), 0)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_currency(c: Column) -> Column:
    """Without blanks, thousands commas and currency signs; an amount in parentheses is negative."""
    bare = F.regexp_replace(c, f"{SPACE}|,", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"), "[$€£¥₹]", "")


def js_number(c: Column) -> Column:
    """A text as a number: blank is 0, 0x, 0b and 0o are bases, anything else that is no number is null."""

    def number(t: Column) -> Column:
        based = lambda prefix, base, digits: F.when(F.rlike(t, F.lit(f"^0[{prefix}]{digits}+$")), F.conv(F.substr(t, F.lit(3)), base, 10).try_cast("double"))
        return F.coalesce(
            F.when(t == "", F.lit(0.0)), F.when(F.rlike(t, F.lit(NUMBER)), t.try_cast("double")), based("xX", 16, "[0-9a-fA-F]"), based("bB", 2, "[01]"), based("oO", 8, "[0-7]")
        )

    return let(trim(c), number)


def finite(c: Column) -> Column:
    return let(c, lambda x: F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x))


def to_float(c: Column) -> Column:
    """Number of a text; unlike coercion, an empty text is no number."""
    return let(c, lambda x: F.when(trim(x) != "", finite(js_number(x))))


def to_int(c: Column) -> Column:
    return let(to_float(c), lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"))


def instant(c: Column) -> Column:
    """Moment of a text in one of the usual forms; without a zone it is UTC. Fractions may have up to nine digits and are
    cut to microseconds; offsets are Z, +hh:mm or +hhmm. Forms are tried only on texts that begin as they do."""
    iso = [f"yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]{zone}" for zone in ("XXX", "XX", "")] + ["yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS]", "yyyy-MM-dd"]
    day_first = ["d MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss XX", "d MMM yyyy"]
    month_first = ["MMM d, yyyy", "MMMM d, yyyy"]
    bare = F.regexp_replace(trim(c), "^[A-Z][a-z]{2}, ", "")
    first = lambda t, forms: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])
    begins = lambda t, shape: F.rlike(t, F.lit(shape))
    return let(bare, lambda t: F.when(begins(t, "^[0-9]{4}-"), first(t, iso)).when(begins(t, "^[0-9]{1,2} [A-Za-z]"), first(t, day_first)).when(begins(t, "^[A-Za-z]+ [0-9]"), first(t, month_first)))


def parse_date(c: Column) -> Column:
    return F.date_format(instant(c), ISO)


def absolute_url(c: Column) -> Column:
    """Only an absolute http(s) URL, scheme and host in lower case; else null."""
    t = trim(c)
    head = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    rest = F.substr(t, F.length(head) + 1)
    return F.when(F.rlike(head, F.lit(r"(?i)^https?://")), F.concat(F.lower(head), F.when(F.rlike(rest, F.lit("^/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def to_bool(c: Column) -> Column:
    t = F.lower(trim(c))
    return F.when(t.isin("true", "yes", "1"), F.lit(True)).when(t.isin("false", "no", "0"), F.lit(False))


def null_if_empty(c: Column) -> Column:
    return F.when(trim(c) != "", c)


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "trim": trim,
    "normalizeWhitespace": normalize_whitespace,
    "lower": F.lower,
    "upper": F.upper,
    "stripCurrency": strip_currency,
    "toFloat": to_float,
    "toInt": to_int,
    "parseDate": parse_date,
    "iso8601": parse_date,
    "absoluteUrl": absolute_url,
    "toBool": to_bool,
    "nullIfEmpty": null_if_empty,
}


def pipeline(source: str | None) -> Callable[[Column], Column]:
    """``a|b|c`` as one function of Columns; an unknown name is an error when the program is loaded."""
    names = [x.strip() for x in (source or "").split("|") if x.strip()]
    if unknown := [n for n in names if n not in TRANSFORMS]:
        raise ValueError(f"unknown transform: {', '.join(unknown)}")
    # A transform reads text; what the one before it made is put into text first.
    return lambda c: reduce(lambda x, name: TRANSFORMS[name](x.cast("string")), names, c)


def coerce(c: Column, kind: str) -> Column:
    """Text of a value in its declared type, null where it does not fit."""
    t = F.lower(trim(c))
    n = finite(js_number(c))
    whole = let(n, lambda x: F.when((x == F.floor(x)) & (F.abs(x) <= F.lit(2.0**53)), x.cast("long")))
    forms = {
        "string": c,
        "number": n.cast("string"),
        "integer": whole.cast("string"),
        "boolean": F.when(t.isin("true", "yes", "1", "on"), F.lit("true")).when(t.isin("false", "no", "0", "off", ""), F.lit("false")),
        "date": parse_date(c),
        "url": absolute_url(c),
    }
    if kind not in forms:
        raise ValueError(f"unknown type: {kind}")
    return forms[kind]
