"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

#: Sara am in two parts, and joined.
SARA_AM = ("ํา", "ำ")
#: Characters that are deleted and blanks that count as a space in news texts.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
BLANKS = "[ \\t\u00a0\u3000]+"
#: White space by Unicode, as Java writes it.
SPACE = "(?U)\\s"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def sara_am(text: Column) -> Column:
    return F.replace(text, F.lit(SARA_AM[0]), F.lit(SARA_AM[1]))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _composed(text: Column) -> Column:
    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return compose(text)


def normalize_text(text: Column, compose: bool = True) -> Column:
    """News text in one form: composed, no invisible characters, single blanks, stripped lines, two line ends at most.

    Composition has no built-in; texts of Latin-1 characters are in that form and skip the UDF.
    """
    if compose:
        text = F.when(F.coalesce(text.rlike("^[\\u0000-\\u00ff]*$"), F.lit(True)), text).otherwise(_composed(text))
    out = F.translate(sara_am(text), INVISIBLE, "")
    out = F.regexp_replace(out, "\\r\\n?", "\n")
    out = F.regexp_replace(out, BLANKS, " ")
    out = F.regexp_replace(out, f"(?m)^{SPACE}+$", "")
    out = F.regexp_replace(F.regexp_replace(out, "[^\\S\\n]*\\n[^\\S\\n]*", "\n"), "\n{3,}", "\n\n")
    return stripped(out)


def clean_text(text: Column) -> Column:
    """Joined sara am, stripped, runs of white space as one space; empty for null."""
    return F.regexp_replace(stripped(sara_am(F.coalesce(text, F.lit("")))), f"{SPACE}+", " ")


def squashed(text: Column) -> Column:
    """clean_text without any white space."""
    return F.regexp_replace(sara_am(F.coalesce(text, F.lit(""))), f"{SPACE}+", "")


def is_thai(text: Column) -> Column:
    return F.coalesce(text.rlike("[\u0e00-\u0e7f]"), F.lit(False))


def identity_text(text: Column) -> Column:
    """A 13-digit identity number in groups is written 1 2345 67890 12 3; lone marks go; anything else stays."""
    cleaned = clean_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!\S)[|.,:;'`_\-]+(?!\S)", " "))

    def grouped(c: Column) -> Column:
        digits = F.regexp_replace(c, f"{SPACE}", "")
        regrouped = F.regexp_replace(digits, r"^(\d)(\d{4})(\d{5})(\d{2})(\d)$", "$1 $2 $3 $4 $5")
        return F.when(digits.rlike(r"^\d{13}$") & (digits != c), regrouped).otherwise(c)

    return let(cleaned, grouped)
