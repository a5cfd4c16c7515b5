"""Times written in any format, precision and zone, as one UTC instant.

All formats are one regular expression: an alternation with named groups, run once over a text. The parts are held
against the calendar and put together with whole-number day arithmetic; local times go through the zone's rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.urls import host_of
from pagewright.sources.tables import table

# Month names of the languages of the sites.
MONTHS = {
    1: "january januar jänner janvier enero jan janv ene",
    2: "february februar février fevrier febrero feb févr fev",
    3: "march märz maerz mars marzo mar mär mrz",
    4: "april avril abril apr avr abr",
    5: "may mai mayo",
    6: "june juni juin junio jun",
    7: "july juli juillet julio jul juil",
    8: "august août aout agosto aug ago",
    9: "september septembre septiembre setiembre sept sep",
    10: "october oktober octobre octubre oct okt",
    11: "november novembre noviembre nov",
    12: "december dezember décembre decembre diciembre dec dez déc dic",
}
# Hours from UTC of zone abbreviations, by the region in which a site's zone lies; "" holds everywhere else.
ABBREVIATIONS = {
    "": {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3, "JST": 9, "KST": 9, "IST": 5.5, "PKT": 5,
         "HKT": 8, "SGT": 8, "WIB": 7, "ICT": 7, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
         "AST": -4, "ADT": -3, "NST": -3.5, "NDT": -2.5, "BRT": -3, "ART": -3, "AEST": 10, "AEDT": 11, "ACST": 9.5, "ACDT": 10.5, "AWST": 8, "NZST": 12, "NZDT": 13, "SAST": 2},
    "Australia": {"EST": 10, "EDT": 11, "CST": 9.5, "CDT": 10.5, "WST": 8},
    "Asia": {"CST": 8, "PST": 8, "BST": 6, "AST": 3, "GST": 4},
    "Europe": {"IST": 1},
}
ORDERS = {"dmy": (2, 1, 0), "mdy": (2, 0, 1), "ymd": (0, 1, 2)}


def alternation() -> str:
    """The one expression. A group's name ends in the number of its format, as a name may stand only once."""
    month = "|".join(sorted({n for x in MONTHS.values() for n in x.split()}, key=len, reverse=True))
    zone = r"(?:\s?(?P<off#>(?:GMT|UTC)?[+\-\u2212]\d{1,2}(?::?\d\d)?)(?![\d:])|\s?(?P<abb#>(?-i:Z|[A-Z]{2,5}))\b(?![\w/])|\s?(?P<zone#>(?-i:[A-Z])\w+(?:/[A-Z][\w+\-]*)+))?(?:\s?[\[(](?P<iana#>[A-Za-z][\w/+\-]*)[\])])?"
    clock = r"(?P<h#>\d{1,2})(?:[:.h]|\s?h\s?)(?P<mi#>\d\d)(?:[:.](?P<s#>\d\d)(?:[.,](?P<frac#>\d{1,12}))?)?(?:\s?(?P<half#>[AP]\.?M\b\.?))?(?:\s?Uhr\b)?"
    after = rf"(?:(?:,?\s|,|\s?T|\s(?:at|à|um|a\slas|kl\.?)\s|,\s(?:at|um)\s){clock}{zone})?"
    weekday = r"(?:[^\W\d_]{2,10}\.?,?\s)?"
    day, name, year = r"(?P<d#>\d{1,2})", rf"(?P<mon#>{month})\b\.?", r"(?P<y#>\d{4})"
    formats = [
        rf"{year}-(?P<mo#>\d\d)-(?P<d#>\d\d)(?:(?:[T\s]|\sat\s){clock}{zone})?",
        rf"{year}(?P<mo#>\d\d)(?P<d#>\d\d)T?(?P<h#>\d\d)(?P<mi#>\d\d)(?P<s#>\d\d)(?:[.,](?P<frac#>\d+))?(?P<abb#>Z)\b",
        rf"{year}(?P<mo#>\d\d)(?P<d#>\d\d)T(?P<h#>\d\d)(?P<mi#>\d\d)(?:(?P<s#>\d\d)(?:[.,](?P<frac#>\d+))?)?{zone}",
        rf"(?P<p#>\d{{1,4}})(?P<sep#>[/.\-])(?P<q#>\d{{1,2}})(?P=sep#)(?P<r#>\d{{4}}|\d{{1,2}}){after}",
        rf"{weekday}{day}(?:\.|st|nd|rd|th|er|º)?(?:\sde|\sof)?[\s\-]{name}(?:\sde|,)?[\s\-]{year}{after}",
        rf"{weekday}{name}\s{day}(?:st|nd|rd|th)?(?:,\s?|\s){year}{after}",
        rf"{year}年(?P<mo#>\d{{1,2}})月(?P<d#>\d{{1,2}})日(?:\s?(?P<h#>\d{{1,2}})(?::|時)(?P<mi#>\d\d)分?)?",
        r"(?P<unix#>\d{16}|\d{13}|\d{9,10})",
    ]
    return "|".join(r"(?<![\w.,:/+\-])(?P<f#>".replace("#", str(i)) + f.replace("#", str(i)) + r")(?![\w/]|[.,:\-]\d)" for i, f in enumerate(formats))


def days(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 to a date of the Gregorian calendar."""
    y -= m <= 2
    era, month = y // 400, (m + 9) % 12
    of_era = y - era * 400
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + (153 * month + 2) // 5 + d - 719469


def month_length(y: int, m: int) -> int:
    return (31, 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


class Clock:
    """Reads texts; keeps the compiled expression and the zones it met."""

    def __init__(self):
        import re
        import unicodedata

        self.find = re.compile(alternation(), re.I).finditer
        self.plain = lambda x: x if x.isascii() else unicodedata.normalize("NFKC", x)
        self.month = {n: k for k, x in MONTHS.items() for n in x.split()}
        self.zones: dict = {}
        self.names: dict = {}

    def zone(self, name: str | None):
        if name not in self.zones:
            from zoneinfo import ZoneInfo

            try:
                self.zones[name] = ZoneInfo(name)
            except Exception:  # noqa: BLE001 - no such zone
                self.zones[name] = None
        return self.zones[name]

    def abbreviation(self, name: str, site: str | None):
        """Seconds from UTC, or None where the letters are no zone. The site's own zone comes first, then its region."""
        if (name, site) not in self.names:
            from datetime import datetime

            own = {}
            if zone := self.zone(site):
                for year in range(2000, 2038, 3):
                    for month in (1, 7):
                        at = datetime(year, month, 1, tzinfo=zone)
                        own[at.tzname()] = at.utcoffset().total_seconds() / 3600
            region = ABBREVIATIONS.get((site or "").split("/")[0], {})
            hours = own.get(name, region.get(name, ABBREVIATIONS[""].get(name)))
            self.names[name, site] = None if hours is None else int(hours * 3600)
        return self.names[name, site]

    def local(self, y: int, m: int, d: int, seconds: int, name: str | None):
        """UTC seconds of a local time: the first of two, a skipped one moved by the gap. None without a known zone."""
        from datetime import datetime, timedelta

        zone = self.zone(name)
        if zone is None:
            return None
        at = datetime(y, m, d) + timedelta(seconds=seconds)
        return days(y, m, d) * 86400 + seconds - int(at.replace(tzinfo=zone).utcoffset().total_seconds())

    def instant(self, match, site: str | None, order: str | None):
        """Microseconds since 1970 of one match, or None where it denotes no moment."""
        i = match.lastgroup[1:] if match.lastgroup[0] == "f" else None
        found = match.groupdict()
        i = i or next(k[1:] for k, x in found.items() if x is not None and k[0] == "f" and k[1:].isdigit())
        part = lambda k: found.get(k + i)
        if unix := part("unix"):
            return int(unix) * {16: 1, 13: 1000}.get(len(unix), 1_000_000)
        if part("sep"):
            three = [part("p"), part("q"), part("r")]
            if len(three[0]) == 3:
                return None
            if len(three[0]) == 4:
                where = ORDERS["ymd"]
            else:
                where = ORDERS.get(order or "")
                if len(three[2]) == 4 and where and where[0] == 0:  # the year stands last on a site that writes it first
                    where = ORDERS["mdy" if int(three[0]) <= 12 else "dmy"]
            if where is None or len(three[where[0]]) == 1 or any(len(three[k]) == 4 for k in where[1:]):
                return None
            y, m, d = (int(three[k]) for k in where)
            y += 2000 if len(three[where[0]]) == 2 else 0
        else:
            y, d = int(part("y")), int(part("d"))
            m = self.month[part("mon").lower()] if part("mon") else int(part("mo"))
        if not (1 <= m <= 12 and 1 <= y <= 9998 and 1 <= d <= month_length(y, m)):
            return None
        h, mi, s = int(part("h") or 0), int(part("mi") or 0), int(part("s") or 0)
        if half := part("half"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (half[0] in "Pp")
        if mi > 59 or s > 59 or h > 23 and (h, mi, s) != (24, 0, 0):
            return None
        seconds = h * 3600 + mi * 60 + s
        if off := part("off"):
            off = off.upper().removeprefix("GMT").removeprefix("UTC").replace("\u2212", "-")
            digits = off[1:].replace(":", "")
            hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
            if hours > 18 or minutes > 59:
                return None
            utc = days(y, m, d) * 86400 + seconds - (hours * 3600 + minutes * 60) * (-1 if off[0] == "-" else 1)
        else:
            named, abb = part("iana") or part("zone"), part("abb")
            shift = self.abbreviation("UTC" if abb.upper() == "Z" else abb, site) if abb else None
            if shift is not None:
                utc = days(y, m, d) * 86400 + seconds - shift
            else:
                utc = self.local(y, m, d, seconds, named if named and self.zone(named) else site)
        if utc is None:
            return None
        return utc * 1_000_000 + int(((part("frac") or "") + "000000")[:6])

    def read(self, text: str | None, site: str | None, order: str | None):
        """The one moment that a text denotes, in microseconds since 1970; None where it is none, or several."""
        if not text:
            return None
        found = {self.instant(m, site, order) for m in self.find(self.plain(text))}
        return found.pop() if len(found) == 1 else None


@F.pandas_udf(T.LongType())
def to_utc_us(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(text, site's zone name, site's date order) to microseconds since 1970 UTC, null where the text is no one moment."""
    clock = Clock()
    for text, zone, order in parts:
        none = lambda x: x if isinstance(x, str) else None
        yield pd.Series([clock.read(none(t), none(z), none(o)) for t, z, o in zip(text, zone, order, strict=True)], dtype="Int64")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """outcome_id and utc_us of every date outcome that denotes one moment.

    Null or empty texts, and local times of hosts that are not in ``site``, give no row. The site table is joined on the
    host; Spark broadcasts it by its size (48 rows) and would shuffle it if it were large.
    """
    outcomes = table(spark, sf_dir, "outcomes").filter("value_type = 'date'").select("outcome_id", "source_url", F.coalesce("raw_text", "value").alias("text"))
    outcomes = outcomes.filter(F.rlike("text", F.lit(r"\d")))
    site = table(spark, sf_dir, "site").select(F.lower("host").alias("host"), "time_zone", "date_order").dropDuplicates(["host"])
    dated = outcomes.withColumn("host", host_of(F.col("source_url"))).join(site, "host", "left")
    return dated.select("outcome_id", to_utc_us("text", "time_zone", "date_order").alias("utc_us")).filter("utc_us IS NOT NULL")
