"""Cleaners of ledger cells. Each gives struct<value, certain>: a dash is (null, true), an unread cell (null, false)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkfold.functions.text import SPACE, clean_text, let, sara_am, stripped

#: Letters that stand for digits, by what readers of handwriting return. Fixed values.
GLYPHS = "OoDQlIi|!zZ$B%SsGbTgq"
DIGITS = "000011111228885566799"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
#: Most cells: figures and dates in plain digits, and what has no letter. Each is read as the general way would.
PLAIN_NUMBER, PLAIN_DATE, NO_LETTER = r"\A[0-9]{1,9}\z", r"\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}\z", r"\A[0-9/]+\z"
DASHES = ["-", "–", "—", "~", "_", "=", ""]
#: Months, short without dots and in full. Fixed values.
SHORT_MONTHS = ["มค", "กพ", "มีค", "เมย", "พค", "มิย", "กค", "สค", "กย", "ตค", "พย", "ธค"]
MONTHS = ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม"]


def _raw(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit("")))


def normalise_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), GLYPHS, DIGITS)


def arabic(text: Column) -> Column:
    return F.translate(text, THAI_DIGITS, "0123456789")


def found(value: Column, certain: Column | bool) -> Column:
    return F.struct(value.alias("value"), (F.lit(certain) if isinstance(certain, bool) else certain).alias("certain"))


def quantity(text: Column) -> Column:
    """struct<value int, certain boolean> of a quantity cell.

    Glyphs are substituted; words without a digit or Latin letter (units) are dropped; the rest must be digits after blanks,
    commas and dots go. Certain if nothing was substituted.
    """
    none = F.lit(None).cast("int")
    # words without a digit or Latin letter are units
    joined = lambda t: F.regexp_replace(t, r"(?U)(?<!\S)[^\p{Nd}A-Za-z\s]+(?!\S)|[\s,.]", "")

    def read(c: Column) -> Column:
        value = arabic(c["read"]).cast("string").try_cast("int")
        return F.when(c["read"].rlike(r"^\p{Nd}+$"), found(value, c["plain"].rlike(r"^\p{Nd}+$"))).otherwise(found(none, False))

    def cell(raw: Column) -> Column:
        both = F.struct(joined(normalise_digits(raw)).alias("read"), joined(raw).alias("plain"))
        return F.when(raw.isin(DASHES), found(none, True)).otherwise(let(both, read))

    # what most cells are, without the dear rest
    return F.when(text.rlike(PLAIN_NUMBER), found(text.try_cast("int"), True)).when(text.isin(DASHES), found(none, True)).otherwise(let(_raw(text), cell))


def holds_two_figures(text: Column) -> Column:
    """Whether two or more groups between blanks have two digits or more."""
    groups = F.transform(F.split(_raw(normalise_digits(text)), f"{SPACE}+"), lambda w: F.length(F.regexp_replace(w, r"\P{Nd}", "")))
    return F.coalesce(text.rlike(SPACE), F.lit(False)) & (F.size(F.filter(groups, lambda n: n >= 2)) >= 2)


def build_date(day: Column, month: Column, year: Column) -> Column:
    """A date of the Buddhist era: years of two digits at most are of the 26th century; null if there is no such day."""
    n = arabic(year).try_cast("int")
    full = F.when(F.length(year) <= 2, n + 2500).otherwise(n)
    common = F.when(full > 2400, full - 543).otherwise(full)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", common, arabic(month).try_cast("int"), arabic(day).try_cast("int")), "yyyy-MM-dd")


def numeric_date(text: Column) -> Column:
    """struct<value date, certain boolean> of a d/m/yy cell; a bare run of digits counts if it splits in one way."""
    none = F.lit(None).cast("date")

    def split_run(run: Column) -> Column:
        ways = [
            F.struct(F.substring(run, 1, d).alias("d"), F.substring(run, d + 1, m).alias("m"), F.substring(run, d + m + 1, 2).alias("y"), F.lit(d + m + 2).alias("n"))
            for d in (1, 2) for m in (1, 2)
        ]
        day, month = (lambda w: w["d"].try_cast("int")), (lambda w: w["m"].try_cast("int"))
        fits = F.filter(F.array(*ways), lambda w: (w["n"] == F.length(run)) & day(w).between(1, 31) & month(w).between(1, 12))
        return let(fits, lambda f: F.when(F.size(f) == 1, found(build_date(F.get(f, 0)["d"], F.get(f, 0)["m"], F.get(f, 0)["y"]), False)).otherwise(found(none, False)))

    def cell(c: Column) -> Column:
        p = c["parts"]
        three = found(build_date(F.get(p, 0), F.get(p, 1), F.get(p, 2)), c["raw"] == c["read"])
        return F.when(c["raw"] == "", found(none, True)).when(F.size(p) == 3, three).otherwise(let(F.array_join(p, ""), split_run))

    def parts(raw: Column) -> Column:
        read = normalise_digits(raw)
        return F.struct(raw.alias("raw"), read.alias("read"), F.filter(F.split(arabic(read), "[^0-9]+"), lambda w: w != "").alias("parts"))

    # what most cells are: years of two digits are of the 26th century
    part = lambda n: F.split_part(text, F.lit("/"), F.lit(n))
    plain = F.concat_ws("-", (part(3).cast("int") + 2500 - 543).cast("string"), part(2), part(1)).try_cast("date")
    return F.when(text.rlike(PLAIN_DATE), found(plain, True)).otherwise(let(let(_raw(text), parts), cell))


def is_date_range(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\d+\s*-\s*\d+"), F.lit(False))


def month_of(compact: Column) -> Column:
    """struct<value int, certain boolean>: a month named in full or short; null if none is."""
    letters = F.regexp_replace(compact, "[^\u0e00-\u0e7f]", "")
    out = None
    for names, text in ((MONTHS, letters), (SHORT_MONTHS, compact)):
        for n, name in enumerate(names, 1):
            hit = text.contains(name)
            out = F.when(hit, n) if out is None else out.when(hit, n)
    return found(out.cast("int"), True)


def thai_date(text: Column, fuzzy=None) -> Column:
    """struct<value date, certain boolean> of a date with a Thai month.

    fuzzy(letters) may read months spelt wrong; as it stands inside a lambda, it must not be a Python function: similar.month_like
    is put into a column before.
    """
    none = F.lit(None).cast("date")

    def month(compact: Column) -> Column:
        exact = month_of(compact)
        return exact if fuzzy is None else F.when(exact["value"].isNotNull(), exact).otherwise(fuzzy(F.regexp_replace(compact, "[^\u0e00-\u0e7f]", "")))

    def dated(c: Column) -> Column:
        n, m = c["numbers"], c["month"]
        ok = m["value"].isNotNull() & (F.size(n) >= 2)
        return F.when(ok, found(build_date(F.get(n, 0), m["value"].cast("string"), F.element_at(n, -1)), m["certain"])).otherwise(found(none, False))

    def cell(raw: Column) -> Column:
        compact = sara_am(F.regexp_replace(raw, r"(?U)[\s.]", ""))
        parts = let(compact, lambda c: F.struct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)")).alias("numbers"), month(c).alias("month")))
        return F.when((raw == "") | is_date_range(raw), found(none, True)).otherwise(let(parts, dated))

    # without a letter there is no month
    return F.when(text.rlike(NO_LETTER), found(none, False)).otherwise(let(_raw(text), cell))


def thai_date_text(raw: Column, value: Column) -> Column:
    """value as raw wrote it: with the month in full if raw has one, and as many digits of the year."""
    letters = F.regexp_replace(sara_am(F.coalesce(raw, F.lit(""))), "[^\u0e01-\u0e4e]", "")
    numbers = F.regexp_extract_all(F.regexp_replace(F.coalesce(raw, F.lit("")), SPACE, ""), F.lit(r"(\p{Nd}+)"))
    short = (F.size(numbers) > 0) & (F.length(F.element_at(F.concat(numbers, F.array(F.lit(""))), -2)) == 2)
    year = F.year(value) + 543
    shown = F.when(F.coalesce(short, F.lit(False)), F.lpad((year % 100).cast("string"), 2, "0")).otherwise(year.cast("string"))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(value))
    return F.when(F.length(letters) >= 4, F.concat_ws(" ", F.dayofmonth(value).cast("string"), month, shown)).otherwise(clean_text(raw))


def batch_no(text: Column) -> Column:
    """struct<value string, certain boolean>: up to three letters and digits, closed up; other texts as they are."""
    pattern = r"^([A-Za-z]{0,3})(?U:[\s.])*((?U:[\d\s])+)$"

    def cell(raw: Column) -> Column:
        closed = F.concat(F.upper(F.regexp_extract(raw, pattern, 1)), F.regexp_replace(F.regexp_extract(raw, pattern, 2), SPACE, ""))
        return F.when(raw == "", found(F.lit(""), True)).when(raw.rlike(pattern), found(closed, True)).otherwise(found(raw, False))

    return let(_raw(text), cell)
