"""Small functions of the engine as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.transforms import SPACE, normalize_whitespace

# What counts as a secret in free text, in the order in which the rules are applied.
REDACTIONS = [
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]{8,}\b"),
    ("basic-auth", r"(?i)\bBasic\s+[A-Za-z0-9+/=]{8,}\b"),
    ("authorization-header", r"(?i)\b(authorization|x-api-key|x-auth-token)\s*[:=]\s*[\"']?[^\"'\s,}]+"),
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws-secret", r"(?i)\baws_secret_access_key\s*[:=]\s*[\"']?[A-Za-z0-9/+=]{40}"),
    ("stripe-like", r"\b(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}\b"),
    ("github-pat", r"\bghp_[A-Za-z0-9]{36,}\b"),
    ("slack-token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("cookie-session", r"(?i)\b(session|sessionid|sid|connect\.sid)\s*=\s*[^;\s,]{8,}"),
]
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def ascii_words(pattern: str) -> str:
    """The pattern with word edges of ASCII letters only, as Java's own edges know Unicode."""
    out = re.sub(r"^(\(\?i\))?\\b", lambda m: (m[1] or "") + r"(?<!\\w)".replace("\\\\", "\\"), pattern)
    return re.sub(r"\\b$", lambda _: r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", out)


def redact(c: Column) -> Column:
    """Secrets in a text replaced by ``[REDACTED:kind]``, rule by rule."""
    return reduce(lambda x, rule: F.regexp_replace(x, ascii_words(rule[1]), f"[REDACTED:{rule[0]}]"), REDACTIONS, c)


def redact_nested(c: Column, kind: T.DataType) -> Column:
    """Every text inside a nested value redacted; keys stay. Driven by the schema, so no recursion at run time."""
    if isinstance(kind, T.StringType):
        return redact(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: redact_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[redact_nested(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def redact_auth_headers(headers: Column) -> Column:
    """Values of credential headers hidden, the scheme kept."""
    secret = lambda k: F.lower(k).isin("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")
    return F.transform_values(headers, lambda k, v: F.when(secret(k), F.regexp_replace(v, r"^(\w+\s+)?.*$", "$1***")).otherwise(v))


def lower_keys(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def tokens(c: Column, per: int = 4) -> Column:
    """Estimate of a text's tokens: a quarter of its characters, rounded up."""
    return F.coalesce(F.ceil(F.length(c) / per), F.lit(0)).cast("long")


def half_up(c: Column, places: int) -> Column:
    """Rounded so that halves go up, below zero too."""
    return F.floor(c * 10**places + 0.5) / 10**places


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s_\-]", ""), r"[\s_\-]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def duration_ms(c: Column) -> Column:
    """``30s``, ``5m``, ``2h`` or ``1d`` in milliseconds; anything else is null."""
    part = lambda i: F.regexp_extract(c, r"(?i)^\s*(\d+)\s*([smhd])\s*$", i)
    unit = F.lower(part(2))
    factor = reduce(lambda x, u: x.when(unit == u, F.lit(UNITS[u])), UNITS, F.when(F.lit(False), F.lit(0)))
    return part(1).try_cast("long") * factor


def duration_text(ms: Column) -> Column:
    """The largest unit that divides a duration, seconds otherwise."""
    exact = lambda u: F.concat((ms / UNITS[u]).cast("long").cast("string"), F.lit(u))
    return F.when(ms % UNITS["d"] == 0, exact("d")).when(ms % UNITS["h"] == 0, exact("h")).when(ms % UNITS["m"] == 0, exact("m")).otherwise(F.concat(F.floor(ms / 1000 + 0.5).cast("string"), F.lit("s")))


def display_duration(ms: Column) -> Column:
    one = lambda x: F.format_string("%.1f", half_up(x, 1))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(one(ms / 1000), F.lit("s"))).otherwise(F.concat(one(ms / 60000), F.lit("m")))


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], c)


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    """Exponential wait before the next attempt, without jitter."""
    return F.least(F.lit(float(most)), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def retry_after_ms(c: Column, now: Column) -> Column:
    """``Retry-After`` as seconds or as an HTTP date, never negative; null where it is neither."""
    date = F.try_to_timestamp(F.regexp_replace(c, "^[A-Z][a-z]{2}, ", ""), F.lit("d MMM yyyy HH:mm:ss 'GMT'"))
    seconds = F.when(F.rlike(c, F.lit(r"^\s*\d+(\.\d+)?\s*$")), F.trim(c).try_cast("double") * 1000)
    wait = F.coalesce(seconds, (F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait)).cast("long")


def semver(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"^(\d+)\.(\d+)\.(\d+)$", i).try_cast("int")
    return F.when(F.rlike(c, F.lit(r"^\d+\.\d+\.\d+$")), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def glob_regex(c: Column) -> Column:
    """Robots pattern as an anchored expression: ``*`` is anything, a last ``$`` the end, all else itself."""
    ends = F.rlike(c, F.lit(r"\$$"))
    body = F.when(ends, F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    body = F.replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), body, F.when(ends, F.lit("$")).otherwise(F.lit("")))


def without_comment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def env_key(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.regexp_replace(c, r"[-\s]", "_")))


def grounded_in(text: Column, page: Column) -> Column:
    """Why a text is not grounded in its page, both normalized; null where it is: empty-source, empty-text or not-in-source."""
    return F.when(F.coalesce(page, F.lit("")) == "", "empty-source").when(F.coalesce(text, F.lit("")) == "", "empty-text").when(~F.contains(page, text), "not-in-source")


def grounding(raw: Column, source: Column) -> Column:
    """The same of texts as they stand."""
    return grounded_in(normalize_whitespace(raw), normalize_whitespace(source))


def confidence(rank: Column, n: Column, grounded: Column, validated: Column) -> Column:
    """Score of a field: less for a late locator, much less without grounding, a little more with a passed rule."""
    late = F.when(n > 1, rank / F.greatest(F.lit(1), n - 1) * 0.2).otherwise(F.lit(0.0))
    score = F.lit(1.0) - late - F.when(grounded, F.lit(0.0)).otherwise(F.lit(0.5)) + F.when(validated, F.lit(0.05)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(c, F.lit('[",\r\n]')), quoted).otherwise(F.coalesce(c, F.lit("")))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def field_diff(ok: Column, exact: Column, value: Column, wanted: Column) -> Column:
    """missing, unexpected-failure, value-mismatch or ok of one expected field; a null ``ok`` means it is absent."""
    return F.when(ok.isNull(), "missing").when(~ok, "unexpected-failure").when(exact & ~value.eqNullSafe(wanted), "value-mismatch").otherwise("ok")


__all__ = [n for n in dir() if not n.startswith("_")] + ["SPACE"]
