"""Dates of news: feed and page dates, dates in urls, Thai dates in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkfold.functions.cells import MONTHS, SHORT_MONTHS, arabic
from inkfold.functions.text import let, stripped

ENGLISH = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Hours of the zone names that mail dates may have.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

#: Month names in text, longest first; a stop and blanks may stand between any two of their characters.
_NAMES = sorted([*MONTHS, *SHORT_MONTHS], key=len, reverse=True)
THAI_DATE = r"(?<!\d)(\d{1,2})\s*(" + "|".join(r"\.?\s*".join(name) for name in _NAMES) + r")\.?\s*(\d{4}|\d{2})(?!\d)"


def timestamp(text: Column) -> Column:
    """A timestamp from a mail date, an ISO 8601 date or one of five plain forms; null if none fits."""
    t = stripped(F.coalesce(text, F.lit("")))
    mail = F.regexp_replace(t, r"^(?i)[a-z]{3,9},?\s+(?=\d)", "")
    for name, hours in ZONES.items():
        mail = F.regexp_replace(mail, rf" {name}$", f" {hours}")
    mail = F.regexp_replace(mail, r"\s+", " ")
    iso = F.regexp_replace(F.regexp_replace(t, r"[zZ]$", "+00:00"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d\d-\d\d) (?=\d)", "$1T")
    forms = [
        *(F.try_to_timestamp(mail, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")),
        F.when(iso.rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?([+-]\d\d:\d\d)?)?$"), iso.try_cast("timestamp")),
        F.try_to_timestamp(F.regexp_extract(t, r"^[A-Za-z]{3}, (\d{1,2}/\d{1,2}/\d{4} - \d{1,2}:\d{2})$", 1), F.lit("M/d/yyyy - H:mm")),
        *(F.try_to_timestamp(t, F.lit(f)) for f in ("d MMMM yyyy", "MMMM d, yyyy", "yyyy/M/d", "d/M/yyyy")),
    ]
    return F.coalesce(*forms)


def from_url(url: Column) -> Column:
    """The date in a url's path: year, month and day, year and a month's name, or year and month (the day is then 1).

    The first of these forms that gives a valid date wins.
    """
    path = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    named = F.array_position(F.array(*map(F.lit, ENGLISH)), F.lower(F.regexp_extract(path, r"/20\d{2}/([A-Za-z]+)/", 1)))

    def date(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.nullif(year, F.lit("")), month, day), "yyyy-M-d")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(path, pattern, group)

    whole, month = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$|[.-])", r"/(20\d{2})/(\d{1,2})(?:/|$)"
    return F.coalesce(
        date(part(whole, 1), part(whole, 2), part(whole, 3)),
        F.when(named > 0, date(part(r"/(20\d{2})/[A-Za-z]+/", 1), named.cast("string"), F.lit("1"))),
        date(part(month, 1), part(month, 2), F.lit("1")),
    )


def thai_in_text(text: Column) -> Column:
    """The earliest valid Buddhist date written in a text; years of two digits are of the 26th century."""
    t = arabic(F.coalesce(text, F.lit("")))
    names = F.array(*map(F.lit, MONTHS)), F.array(*map(F.lit, SHORT_MONTHS))

    def date(hit: Column) -> Column:
        part = lambda n: F.regexp_extract(hit, THAI_DATE, n)
        month = F.greatest(*(F.array_position(own, F.regexp_replace(part(2), r"[\s.]", "")) for own in names))
        year = part(3).cast("int") + F.when(F.length(part(3)) == 2, 2500 - 543).otherwise(-543)
        return F.try_to_date(F.format_string("%04d-%d-%d", year, month, part(1).cast("int")), "yyyy-M-d")

    dates = F.filter(F.transform(F.regexp_extract_all(t, F.lit(THAI_DATE), F.lit(0)), date), lambda d: d.isNotNull())
    return let(dates, lambda d: F.get(d, F.lit(0)))


def within(published: Column, cutoff: Column) -> Column:
    """Whether an article is recent; articles without a readable date are kept."""
    return F.coalesce(timestamp(published) >= cutoff, F.lit(True))
